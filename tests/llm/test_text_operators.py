import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeline.llm import html_extraction, jaccard_join, mixing, packing, sharding, suffix_dedup, url_filters
from cladeline.llm.suffix_array import common_prefixes, merge_minima, suffix_array

from . import helpers


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return helpers.frame(spark, helpers.documents(), tmp_path_factory.mktemp("docs"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return helpers.frame(spark, [], tmp_path_factory.mktemp("empty"), files=1)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- near duplicates


def test_jaccard_join_is_brute_force(docs, plain):
    want = helpers.components(plain)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(plain)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(helpers.shingles(t))) for d, t in plain)
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_prefixes_of_linked_sets_share_what_they_must(seed):
    from cladeline.llm.shingles import enough, least_shared, prefix_length

    rng = random.Random(seed)
    for _ in range(3_000):
        n = rng.randrange(1, 120)
        x = set(rng.sample(range(400), n))
        y = set(x)
        for _ in range(rng.randrange(0, n // 4 + 2)):
            if rng.random() < 0.5 and y:
                y.discard(rng.choice(sorted(y)))
            else:
                y.add(rng.randrange(400))
        if y and enough(len(x & y), len(x), len(y)):
            a, b = sorted(x)[: prefix_length(len(x))], sorted(y)[: prefix_length(len(y))]
            assert len(set(a) & set(b)) >= max(least_shared(len(x)), 0) or len(set(a) & set(b)) >= least_shared(len(y))
            assert len(set(a) & y) >= 1 and len(set(a) & set(b)) >= min(least_shared(len(x)), least_shared(len(y)))


def test_a_linked_document_is_never_pruned():
    """The count that pruning looks at is of the prefix shingles that any other prefix holds."""
    from cladeline.llm.shingles import enough, least_shared, prefix_length

    rng = random.Random(9)
    for _ in range(3_000):
        n = rng.randrange(1, 150)
        x = set(rng.sample(range(1000), n))
        drop = rng.sample(sorted(x), rng.randrange(0, n // 4 + 1))
        y = (x - set(drop)) | set(rng.sample(range(1000, 2000), rng.randrange(0, n // 3 + 1)))
        if y and enough(len(x & y), len(x), len(y)):
            a, b = set(sorted(x)[: prefix_length(len(x))]), set(sorted(y)[: prefix_length(len(y))])
            assert len(a & b) >= least_shared(len(x)) and len(a & b) >= least_shared(len(y))


def test_rules_of_several_sweeps(spark, monkeypatch):
    rng = __import__("random").Random(4)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "net", "b.net", "b.b.net"]
    rules = list(dict.fromkeys((rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(["/", "/x", "/x/y", "/é"])) for _ in range(60)))
    urls = [f"http://{rng.choice([*hosts, 'org', 'q.com'])}{rng.choice(['', '/', '/x', '/x/y/z', '/é?u', '#f'])}" for _ in range(80)] + [None, "no url"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    want = sorted(tuple(r) for r in url_filters.url_filter(pages, rules).select("page_id", "rule", "verdict").collect())
    assert any(r[1] for r in want)
    for page, rule, verdict in want:
        r = urls[page]
        host, path = ("", "") if r is None or "://" not in r else (lambda x: (x.split("/")[0].split("?")[0].split("#")[0], x))(r.split("://", 1)[1])
        path = path[len(host) :].split("?")[0].split("#")[0]
        fit = [(-len(t), t, act) for act, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        assert (rule, verdict) == ((min(fit)[1], min(fit)[2]) if fit else (None, "allow"))
    monkeypatch.setattr(url_filters, "SWEEP_RULES", 7)
    assert sorted(tuple(r) for r in url_filters.url_filter(pages, rules).select("page_id", "rule", "verdict").collect()) == want
    assert url_filters.url_filter(pages, []).where("verdict = 'allow'").count() == len(urls)


# --- pages without telling names


def _plain_pages(seed=5, n=60):
    """Pages of plain divs: menus, link lists, cookie text and imprints around articles with short paragraphs; (page, the article's blocks)."""
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice("river stone light water garden winter letter morning silver window story people market evening forest house".split())
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    out = []
    for _ in range(n):
        menu = "<div>" + "".join(f"<p>{link()}</p>" for _ in range(rng.randint(4, 8))) + "</div>"
        paragraphs = []
        for _ in range(rng.randint(4, 9)):
            kind = rng.random()
            paragraphs.append(words(25, 70).capitalize() + "." if kind < 0.65 else words(2, 4) if kind < 0.85 else f"{words(3, 5)}, {words(3, 4)}")
        paragraphs[0] = words(30, 60).capitalize() + "."
        paragraphs[-1] = words(30, 60).capitalize() + "."
        article = "<div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>"
        links = "<div>" + "".join(f"<div>{link()}</div>" for _ in range(rng.randint(3, 6))) + "</div>"
        imprint = f"<div><p>{link()}</p><p>{words(8, 12).capitalize()}.</p><p>{link()}</p></div>"
        out.append((f"<html><body>{menu}{article}{links}{imprint}</body></html>", paragraphs))
    return out


def _f1(edges):
    hit = said = want = 0
    for page, truth in _plain_pages():
        got = html_extraction.main_text(page, edges).split("\n\n")
        hit, said, want = hit + len(set(got) & set(truth)), said + len(set(got)), want + len(set(truth))
    return 2 * hit / (said + want)


def test_the_cut_decides_pages_without_telling_names():
    without, cut = _f1(False), _f1(True)
    assert cut > 0.97 and cut > without + 0.05, (without, cut)


def test_the_cut_is_the_cheapest_labelling_of_whole_pages():
    import itertools

    checked = 0
    for page, _ in _plain_pages(8, 40):
        found = html_extraction.blocks(page)[2:14]
        costs = [html_extraction.evidence(*b) for b in found]
        links = [(k - 1, k, html_extraction.smoothness(found[k - 1][1], found[k][1])) for k in range(1, len(found))]
        links += [(k - 2, k, html_extraction.NEXT_BUT_ONE) for k in range(2, len(found)) if found[k - 2][1].parent is found[k][1].parent and found[k - 2][1].frame == found[k][1].frame]
        price = lambda side: sum(abs(c) for c, s in zip(costs, side) if (c > 0) != s and c) + sum(w for i, j, w in links if side[i] != side[j])  # noqa: E731, B023
        best = min(price(side) for side in itertools.product((False, True), repeat=len(found)))
        got = html_extraction.labelled(found)
        assert price(got) == best
        checked += got != html_extraction.labelled(found, edges=False)
    assert checked > 5


def test_extraction_of_nothing_and_of_deep_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_extraction.extract(empty).count() == 0
    deep = "<div>" * 3_000 + "<p>" + "word " * 30 + "end.</p>" + "</div>" * 3_000
    rows = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "   <p> </p>", "x"), (4, "u", deep, "x"), (5, "u", "&lt;no tag&gt; just a long line of words that goes on for quite a while, without any markup at all.", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extraction.extract(rows).collect()}
    assert [got[k].text for k in (1, 2, 3)] == ["", "", ""] and [got[k].n_chars for k in (1, 2, 3)] == [0, 0, 0]
    assert got[4].text == "word " * 30 + "end." and got[5].text.startswith("<no tag> just")
    assert all(r.n_chars == len(r.text) for r in got.values())


# --- suffix arrays


def test_suffix_array_and_prefixes_are_brute_force():
    rng = np.random.default_rng(5)
    for letters, n in ((2, 300), (4, 200), (1, 100), (250, 64)):
        pieces = [rng.integers(0, letters, rng.integers(1, 40)).astype(np.uint8) for _ in range(n // 20)]
        text = np.concatenate([np.r_[p, np.uint8(255)] for p in pieces])
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        starts = ends - [len(p) for p in pieces]
        raw = text.tobytes()
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = common_prefixes(text, sa, starts, ends, 12)
        piece = {i: k for k, (a, b) in enumerate(zip(starts, ends)) for i in range(a, b)}
        for s in range(1, len(sa)):
            i, j = int(sa[s]), int(sa[s - 1])
            if i in piece and j in piece:
                room = min(ends[piece[i]] - i, ends[piece[j]] - j, 12)
                want = next((k for k in range(room) if raw[i + k] != raw[j + k]), room)
                assert lcp[s] == want


def test_parts_meet_by_binary_search():
    parts = [(np.array([b"a", b"c"]), np.array([5, 1])), (np.array([b"b", b"c"]), np.array([2, 0])), (np.array([b"a"]), np.array([3]))]
    assert [x.tolist() for x in merge_minima(parts)] == [[3, 0], [2, 0], [3]]


def test_suffix_dedup_is_brute_force(docs, plain, monkeypatch):
    got = [tuple(r) for r in suffix_dedup.dedup_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=helpers.key) == sorted(helpers.cut(plain), key=helpers.key)


def test_suffix_dedup_with_many_parts(docs, plain, monkeypatch):
    """Suffix arrays of a few hundred bytes, so that shards have many parts to merge."""
    import pyarrow as pa

    text = [t for _, t in plain if t]
    from cladeline.llm.blocks import packing
    from cladeline.llm.common import byte_batch

    ids, bodies = list(range(len(text))), text
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(ids)), pa.array(ids), pa.array(ids, pa.int32()), pa.array(bodies)], names=["block", "doc_id", "rid", "text"])
    packed = pa.Table.from_batches(list(packing(["doc_id", "rid", "text"])([batch])))
    held = defaultdict(list)
    for row, _, _, h in suffix_dedup.pieces(*byte_batch(pa.array(bodies))):
        for r, x in zip(row.tolist(), h.tolist()):
            held[r].append(x & 0xFFFF_FFFF_FFFF_0000)
    shared = pa.table([pa.array([1] * len(held)), pa.array(list(held)), pa.array([np.array(v, np.uint64).view(np.int64) for v in held.values()], pa.list_(pa.int64()))], names=["block", "doc", "keys"])
    sent = suffix_dedup._send(1)(packed, shared)
    whole = suffix_dedup._settle(sent)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2_000)
    parts = suffix_dedup._settle(sent)
    done = [suffix_dedup._cut(False)(packed, x).to_pylist() for x in (whole, parts)]
    assert done[0] == done[1]
    assert [(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in done[0]] == [(d, n, s) for d, _, n, _, s in helpers.cut(list(zip(ids, bodies)))]


def test_a_shard_that_removes_nothing():
    import pyarrow as pa

    from cladeline.llm import shared_keys as keys

    body = b"x" * 60
    row = (0, 1, np.array([9], np.uint64).tobytes(), keys.planes(np.array([4])), keys.planes(np.array([0], np.int32)), keys.planes(np.array([0])), np.array([60], np.uint8).tobytes(), __import__("zstandard").ZstdCompressor().compress(body))
    sent = pa.table([pa.array([x], t) for x, t in zip(row, suffix_dedup._SENT_TYPES)], names=["shard", "block", "hash", "doc", "rid", "at", "size", "body"])
    assert len(suffix_dedup._settle(sent)) == 0


def test_anchors_are_dealt_evenly():
    """An anchor has the least hash of its window; by that hash, the first of 64 shards would take 13 times the mean."""
    from cladeline.llm import shared_keys as keys

    raw = np.random.default_rng(8).integers(32, 127, 400_000).astype(np.uint8)
    names = np.unique(np.concatenate([h for *_, h in suffix_dedup.pieces(raw, np.arange(0, 400_001, 2_000))]))
    held = np.bincount(keys._shard(names, 64), minlength=64)
    assert held.sum() > 20_000 and held.max() < 1.3 * held.mean() and held.min() > 0.7 * held.mean()


def test_words_by_stretches(monkeypatch):
    from cladeline.llm import shingles
    from cladeline.llm.common import byte_batch
    import pyarrow as pa

    texts = ["", "one", "two words", " " * 40, "x" * 90 + " y", "", "a b c d e f g h i j k l m n o p", "tail "] * 3
    raw, offsets = byte_batch(pa.array(texts))
    want = shingles.word_hashes(raw, offsets)
    for chunk in (1, 5, 17, 64, 10_000):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        got = shingles.chunked_words(raw, offsets)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.dedup_spans(empty).count() == 0


# --- html


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("<article><h1>A &amp; B</h1><p>It  is\n so.<br>Yes.</p></article>", "A & B\n\nIt is so. Yes."),
        ("<article><p>one <b>t</b>wo<p>three<script>var x='</p>'</script></article>", "one two\n\nthree"),
        ("<article><p>Kept text of some length here.</p><div class='ad'>Buy now, a very good offer for all of you.</div></article><footer>(c) us</footer>", "Kept text of some length here."),
        ("<article><p>caf&eacute; &#x41; &amp <!-- not this --> &lt;b&gt;</p>", "café A & <b>"),
        ("<html><head><title>T</title></head><body><article><p>unclosed <b>and cut", "unclosed and cut"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ],
)
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        capacity = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(abs(c) for c, s in zip(capacity, side) if (c > 0) != s and c) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: E731, B023
        got = html_extraction.minimum_cut(capacity, edges)
        assert cost(got) == min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))


def test_extract_keeps_other_columns(spark):
    rows = [(1, "u", "<article><p>Some words here.</p></article>", "mine"), (2, None, None, None), (2, None, None, None)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(tuple(r) for r in got.collect() if r.url) == [(1, "u", "Some words here.", 16)]
    assert got.where("text = '' AND n_chars = 0").count() == 2


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "words and words. " * 20 + "</div>" * 20_000
    assert html_extraction.main_text(deep).startswith("words")
    long = "<article>" + "<p>A sentence that counts, with words.</p>" * 3_000 + "</article>"
    assert html_extraction.main_text(long).count("\n\n") == 2_999


# --- urls


def test_url_filter_by_hand(spark):
    rows = [
        ("http://example.com/en/a?x#y", "example.com", "/en/a", "example.com/en/", "block"),
        ("http://www.example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("http://a.www.EXAMPLE.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://example.com/de/", "example.com", "/de/", "com/", "allow"),
        ("http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://n.net/es/1", "n.net", "/es/1", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://n.net/de/", "n.net", "/de/", None, "allow"),
        ("http://com:80/x", "com:80", "/x", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("a://b://c.com/", "b:", "//c.com/", None, "allow"),
        ("http://a..com/p\nq?r", "a..com", "/p\nq", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(k, r[0], "x", 1) for k, r in enumerate(rows)] * 2, "page_id long, url string, rule string, lane long")
    got = url_filters.url_filter(pages)
    assert set(got.columns) == {"page_id", "url", "lane", "host", "path", "rule", "verdict"}
    have = sorted(tuple(r) for r in got.where("url IS NOT NULL").select("page_id", "url", "host", "path", "rule", "verdict").na.fill("-").collect())
    want = sorted([(k, *(x if x is not None else "-" for x in r)) for k, r in enumerate(rows) if r[0] is not None] * 2)
    assert have == want
    assert got.where("url IS NULL AND verdict = 'allow' AND host = ''").count() == 2
    assert url_filters.url_filter(pages.limit(0)).count() == 0
    assert url_filters.url_filter(pages, rules=()).where("rule IS NOT NULL").count() == 0


def test_url_filter_against_all_rules(spark):
    rng = random.Random(8)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = sorted({(h + "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3)))) for h in hosts[:40]})
    rules = [(rng.choice(["allow", "block"]), r) for r in rules]
    urls = [f"http://{rng.choice(hosts)}/{''.join(rng.choice('xy/') for _ in range(4))}" for _ in range(300)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, default="block").collect()}
    for k, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        fits = [(-len(r), r, a) for a, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + p)]
        assert got[k] == ((min(fits)[1], min(fits)[2]) if fits else (None, "block"))


# --- sharding, mixing, packing


def test_differencing_keeps_sums():
    rng = random.Random(2)
    for _ in range(50):
        tuples = [[rng.randrange(100) for _ in range(4)] for _ in range(rng.randrange(1, 9))]
        sums, placed = sharding.differencing(tuples)
        have = [0] * 4
        for t, p in zip(tuples, placed):
            assert sorted(p) == [0, 1, 2, 3]
            for x, k in zip(t, p):
                have[k] += x
        assert have == sums


def _by_the_book(sizes, shards):
    """Differencing with whole lists: the two partial partitions of largest spread are joined, the largest sums of one with the least of the other."""
    held = [(i, [(size, [i])] + [(0, [])] * (shards - 1)) for i, size in enumerate(sizes)]
    number = len(held)
    while len(held) > 1:
        spread = lambda x: (-(x[1][0][0] - x[1][-1][0]), x[0])
        held.sort(key=spread)
        a, b = held.pop(0)[1], held.pop(0)[1]
        both = [(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))]
        order = sorted(range(shards), key=lambda k: (-both[k][0], k))
        held.append((number, [both[k] for k in order]))
        number += 1
    return [(s, sorted(p)) for s, p in held[0][1]]


def test_differencing_is_by_the_book(spark, tmp_path):
    rng = random.Random(12)
    for shards in (2, 3, 16):
        sizes = [rng.randrange(1, 400) for _ in range(60)]
        sums, placed = sharding.differencing([[s] + [0] * (shards - 1) for s in sizes])
        want = _by_the_book(sizes, shards)
        assert sums == [s for s, _ in want]
        assert [sorted(i for i, p in enumerate(placed) if p[0] == k) for k in range(shards)] == [p for _, p in want]
    sizes = rng.sample(range(1, 3_000), 80)
    docs = helpers.frame(spark, [(k, "x" * n, None, None, 0, *"abcde") for k, n in enumerate(sizes)], tmp_path)
    got = {}
    for r in sharding.shard_bytes(docs).collect():
        got.setdefault(r.shard, []).append(r["size"])
    falling = sorted((n + 1 for n in sizes), reverse=True)
    assert sorted((sum(v), sorted(v)) for v in got.values()) == sorted((s, sorted(falling[i] for i in p)) for s, p in _by_the_book(falling, 16))


def test_sharding(docs, plain):
    got = sharding.shard_bytes(docs).collect()
    assert len(got) == len(plain)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in plain)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    home = defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        home[(r["size"], r.text_crc32)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len(s) == 1 for s in home.values())


def test_sharding_balances(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", 50)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    rng = random.Random(1)
    docs = helpers.frame(spark, [(k, "w" * rng.randrange(1, 3000) + str(k), "en", "s", 1, *"abcde") for k in range(600)] + [(1000 + k, "hot", "en", "s", 1, *"abcde") for k in range(300)], tmp_path)
    sizes = {r.shard: r.b for r in sharding.shard_bytes(docs).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.02 * min(sizes.values())  # three groups a bin of a cell


def test_sharding_and_packing_of_nothing(empty):
    assert sharding.shard_bytes(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert mixing.mix_rows(empty).count() == 0


def _targets(sizes, weights, cap=3.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left, weight = total - sum(full.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / weight > cap * sizes[s]]
        if not over:
            return full | {s: left * w[s] / weight for s in rest}
        full |= {s: cap * sizes[s] for s in over}


def test_mixing(docs, plain):
    rows = docs.select("doc_id", "text", "source").collect()
    count = lambda t: len(helpers.WORD.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
    want = _targets(dict(sizes), [1, 2, 3])
    got = mixing.mix_rows(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, count(r.text)) for r in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(2 * mixing.BLOCK, 0.02 * want[s]) for s in want)
    again = mixing.mix_rows(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_every_prefix_of_the_schedule_is_mixed(docs):
    plan, rows = mixing.mix(docs)
    share = {r.source: r.target for r in rows.select("source", "target").distinct().collect()}
    slots = plan.select("slot", "source").distinct().orderBy("slot").collect()
    total, seen = sum(share.values()), Counter()
    for k, r in enumerate(slots, 1):
        seen[r.source] += 1
        if k >= 100 and k < 0.9 * len(slots):
            assert abs(seen[r.source] / k - share[r.source] / total) < 0.05


def test_a_source_that_holds_most_is_capped_by_the_others(spark, tmp_path):
    docs = helpers.frame(spark, [(k, "w " * 30, "en", "big" if k % 10 else "small", 1, *"abcde") for k in range(300)], tmp_path)
    got = {r.source: (r.target, r.t) for r in mixing.mix_rows(docs).groupBy("source", "target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    assert got["small"] == (2700.0, 2700) and got["big"] == (6300.0, 6300)


@pytest.mark.parametrize("big", [30_000, 200_000_000])
def test_quotas_are_met_at_every_size(spark, big):
    quotas = [300, 3_000, 1, big, 300, 0, 3_000, 64]
    targets = spark.createDataFrame([(k, float(q), q) for k, q in enumerate(quotas)], "order_no long, target double, quota long")
    total = sum(quotas)
    slots = mixing.ranked(mixing.schedule(targets, total))
    done = mixing.completed(slots, targets.select("order_no", "quota"), total // mixing.BLOCK + mixing.SPARE)
    got = {r.order_no: r for r in done.groupBy("order_no").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.max("rank").alias("most")).collect()}
    for k, q in enumerate(quotas):
        assert not q or (got[k].n == got[k].ranks == got[k].most + 1 and got[k].n * mixing.BLOCK >= q)
    assert done.count() == done.select("slot").distinct().count()


def test_a_small_source_of_many_documents_is_taken_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SPARE", 0)  # as the reserve is next to nothing on a large table
    docs = helpers.frame(spark, [(k, "w " * 37, "en", "big" if k % 50 else f"s{k // 50}", 1, *"abcde") for k in range(1_000)], tmp_path)
    got = mixing.mix_rows(docs).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(got) == 21 and all(r.t == round(r.target) for r in got)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        k = rng.randint(1, 4)
        waste = lambda cuts: sum(c * min(b for b in cuts if b >= x) for x, c in zip(lengths, counts))  # noqa: E731, B023
        best = min(waste((*c, lengths[-1])) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1].tolist(), m))
        got = packing.boundaries(lengths, counts, k)
        assert waste(got) == best and len(got) <= k and got == sorted(got)


def test_bucket_lengths_are_those_of_documents(spark, tmp_path):
    rng = random.Random(8)
    sizes = [rng.randrange(1, 5_000) for _ in range(150)] + [700, 700, 4_999]
    docs = helpers.frame(spark, [(k, "w " * n, None, None, 0, *"abcde") for k, n in enumerate(sizes)], tmp_path)
    got = packing.pack(docs, buckets=7, budget=9_000).collect()
    by_bucket = {}
    for r in got:
        by_bucket.setdefault((r.bucket, r.length), []).append(r.n_tokens)
    assert sum(map(len, by_bucket.values())) == len(sizes) and all(max(v) == length for (_, length), v in by_bucket.items())
    ends = sorted(length for _, length in by_bucket)
    assert [b for b, _ in sorted(by_bucket)] == list(range(7)) and all(r.length == min(e for e in ends if e >= r.n_tokens) for r in got)


def test_packing(docs, plain):
    got = packing.pack(docs, buckets=4, budget=500).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(helpers.WORD.findall(t or ""))) for d, t in plain)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.length
        batches[(r.bucket, r.batch)].append(r)
    for rows in batches.values():
        assert sorted(r.place for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * max(1, rows[0].length) <= 500


def _template_pages(n, copies=0):
    """Pages of 84 common and 17 own words, no two of which link, and near copies of some."""
    rng = random.Random(4)
    common = [f"c{k}" for k in range(84)]
    pages = [" ".join(common[:40] + [f"own{d}x{k}" for k in range(17)] + common[40:]) for d in range(n)]
    for d in range(copies):
        words = pages[d].split()
        words[rng.randrange(3)] = f"new{d}"
        pages.append(" ".join(words))
    return list(enumerate(pages))


def test_pages_of_one_template_are_not_paired(spark, tmp_path):
    """Their own words tell them apart before any pair is made; near copies among them are found all the same."""
    rows = _template_pages(300, 12)
    docs = helpers.frame(spark, rows, tmp_path, schema="doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == helpers.components(rows) and sum(d != c for d, c in got.items()) == 12


def test_spans_hold_every_pair_that_could_link_once():
    rng = np.random.default_rng(9)
    m = 400
    group, home = np.sort(rng.integers(0, 12, m)), rng.random(m) < 0.7
    n, alone = rng.integers(20, 120, m), rng.integers(-1, 30, m)
    met = [p for i, j in jaccard_join._enumerated(jaccard_join._spans(group, home, n, alone)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len({frozenset(p) for p in met}) == len(met)
    for i in range(m):
        for j in range(i):
            if group[i] == group[j] and (home[i] or home[j]) and (min(alone[i], alone[j]) < 0 or 7 * (alone[i] + alone[j]) <= n[i] + n[j]):
                assert (i, j) in met or (j, i) in met
    # documents that all have many words of their own: none is compared, however many there are
    for m in (100, 10_000):
        every = np.zeros(m, np.int64)
        assert not list(jaccard_join._enumerated(jaccard_join._spans(every, every == 0, every + 101, every + 21)))
