import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeline.llm import ann, quality, top_k

from . import helpers


def _naive_losses(trusted, texts):
    """The model by the book, in dictionaries: texts and trusted are of one language."""
    n = quality.ORDER

    def grams(t):
        padded = (quality.START,) * (n - 1) + tuple(quality.symbols(t).tolist())
        return [padded[i : i + n] for i in range(len(t))]

    count = [None] * (n + 1)
    count[n] = {}
    for t in trusted:
        for g in grams(t):
            count[n][g] = count[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        count[k] = {}
        for g in count[k + 1]:
            count[k][g[1:]] = count[k].get(g[1:], 0) + 1
    discount = [None] * (n + 1)
    for k in range(1, n + 1):
        ones = [sum(c == i for c in count[k].values()) for i in (1, 2, 3, 4)]
        y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] + 2 * ones[1] else None
        discount[k] = [0.0] + [min(max(i - (i + 1) * y * ones[i] / ones[i - 1], 0.1), i) if y is not None and ones[i - 1] else i / 2 for i in (1, 2, 3)]
    context = [None] * (n + 1)
    for k in range(1, n + 1):
        context[k] = {}
        for g, c in count[k].items():
            a = context[k].setdefault(g[:-1], [0, 0.0])
            a[0] += c
            a[1] += discount[k][min(c, 3)]

    @functools.cache
    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        k, low = len(g), p(g[1:])
        if g[:-1] not in context[k]:
            return low
        total, cut = context[k][g[:-1]]
        c = count[k].get(g, 0)
        return (c - discount[k][min(c, 3)] if c else 0.0) / total + cut / total * low

    return [-sum(math.log(p(g)) for g in grams(t)) for t in texts]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return helpers.frame(spark, helpers.documents(), tmp_path_factory.mktemp("q"))


def _naive_words(trusted, text):
    """(losses by the whole model, by the lowest order) of a text's words and the mark of its end, by the book."""
    words = lambda t: ["<", *helpers.WORD.findall(t.translate(helpers.LOWER)), ">"]
    pairs, follow = {}, {}
    for t in trusted:
        w = words(t)
        for p in zip(w, w[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    for _, w in pairs:
        follow[w] = follow.get(w, 0) + 1

    def discounts(counts):
        n = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else None
        return [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i) if y is not None and n[i - 1] else i / 2 for i in (1, 2, 3)]

    d1, d2, total = discounts(follow), discounts(pairs), sum(follow.values())
    even = sum(d1[min(c, 3)] for c in follow.values()) / total / (len(follow) + 1)
    own, whole, low = words(text), 0.0, 0.0
    for v, w in zip(own, own[1:]):
        p = (follow[w] - d1[min(follow[w], 3)]) / total + even if w in follow else even
        low -= math.log(p)
        after = {b: c for (a, b), c in pairs.items() if a == v}
        if after:
            n = sum(after.values())
            p = (after[w] - d2[min(after[w], 3)] if w in after else 0) / n + sum(d2[min(c, 3)] for c in after.values()) / n * p
        whole -= math.log(p)
    return whole, low


def test_losses_are_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(quality.word_model, "TURN_BYTES", 100_000)  # several turns
    trusted = spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")
    rows, langs = quality.losses(docs, trusted)
    got, langs = rows.collect(), {r.lang: r.unknown for r in langs.collect()}
    rows = docs.select("doc_id", "lang", "text", quality.held_out(F.xxhash64("lang", "text")).alias("held")).collect()
    assert len(got) == len(rows) and any(r.held for r in rows)
    for lang in ("en", "de", ""):
        own = [r for r in rows if (r.lang or "") == lang]
        taught = [r.text for r in own if r.text and r.doc_id is not None and r.doc_id % 2 == 1 and r.doc_id < 200 and not r.held]
        want = _naive_losses(taught, [r.text or "" for r in own])
        have = sorted((r.n, r.loss) for r in got if r.lang == lang)
        for (n, x), (m, y) in zip(have, sorted((len(r.text or ""), w) for r, w in zip(own, want)), strict=True):
            assert n == m and abs(x - y) <= 1e-5 * max(1, y)
        short = [r.text for r in own if r.text and len(r.text) < 3_000]
        low = lambda r: -(r.lp + r.unknowns * langs[lang])  # noqa: E731, B023
        have = sorted((r.n_words, low(r) - r.rest, low(r)) for r in got if r.lang == lang and 0 < r.n < 3_000)
        want = sorted((len(helpers.WORD.findall(t)) + 1, *_naive_words(taught, t)) for t in short)
        for x, y in zip(have, want, strict=True):
            assert x[0] == y[0] and all(abs(a - b) <= 1e-4 * max(1, b) for a, b in zip(x[1:], y[1:], strict=True))


def test_each_block_asks_in_one_turn(spark, docs, tmp_path, monkeypatch):
    """One row of sums a block, in doubles, however many turns there are; so no turn reads what another has read."""
    word_model, found = quality.word_model, {}
    flat = quality.located(docs, None, 4, [F.col("doc_id"), F.lit(0).alias("fp"), F.coalesce("lang", F.lit("")).alias("lang"), "text"])
    for turn_bytes in (1 << 40, 20_000):
        monkeypatch.setattr(word_model, "TURN_BYTES", turn_bytes)
        with quality.Scratch(spark, "turns") as store:
            texts = quality.stored(flat, ["doc_id", "fp", "rid", "lang", "text"], store, 4)
            flags = store.put(flat.where("doc_id % 2 = 1").select("block", "rid"), "flags")
            parts = word_model._parts(texts, 5)
            assert len(parts) > 1 and sum(texts.where(part).count() for part in parts) == texts.count()
            sums, langs = word_model.word_sums(texts, flags, 400_000, store)
            free = word_model.zstandard.ZstdDecompressor().decompress
            got = [(r.block, [word_model.unplanes(free(x), np.float64) for x in (r.lp, r.unknown, r.rest)]) for r in sums.collect()]
            assert len(got) == len({block for block, _ in got}) == texts.select("block").distinct().count()
            found[turn_bytes] = dict(got)
            store.close()
    one, many = found.values()
    assert one.keys() == many.keys()
    for block, parts in one.items():
        np.testing.assert_allclose(many[block], parts, rtol=1e-5, atol=1e-5)


def test_decisions_are_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"{rng.choice('abcdefgh')}{k}" for k in range(200)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))
    rows = [(k, text(), rng.choice(["en", "de"]), "s", 0, *"abcde") for k in range(400)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    docs = helpers.frame(spark, rows, tmp_path)
    scored, langs = quality.losses(docs, labels.select("doc_id"))
    unknown = {r.lang: r.unknown for r in langs.collect()}
    marked = [r.asDict() for r in scored.withColumn("held", quality.held_out(F.col("fp"))).collect()]
    for r in marked:
        low = -(r["lp"] + r["unknowns"] * unknown[r["lang"]])
        r["three"] = [(r["loss"], r["n"], quality.PRIOR), (low - r["rest"], r["n_words"], quality.WORD_PRIOR), (low, r["n_words"], quality.WORD_PRIOR)]
    want = {}
    for lang in ("en", "de"):
        own = [r for r in marked if r["lang"] == lang]
        held = [r for r in own if r["held"] and r["doc_id"] % 2 == 0]
        means = [sum(r["three"][m][0] for r in held) / sum(r["three"][m][1] for r in held) for m in range(3)]
        smooth = lambda r: [(x + p * mean) / (n + p) for (x, n, p), mean in zip(r["three"], means, strict=True)]  # noqa: E731, B023
        bins = [sorted(math.floor(smooth(r)[m] / quality.STEP) for r in some) for m, some in enumerate((held, held, [r for r in own if r["doc_id"] % 2 == 0]))]
        at = lambda m, q: next(b for k, b in enumerate(bins[m], 1) if k / len(bins[m]) >= q)  # noqa: E731, B023
        ends = [(at(0, quality.UPPER) + 1) * quality.STEP, (at(1, quality.UPPER) + 1) * quality.STEP, at(2, quality.LOWER) * quality.STEP]
        for r in own:
            s = smooth(r)
            want[r["doc_id"]] = s[0] <= ends[0] and s[1] <= ends[1] and s[2] >= ends[2]
    assert {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()} == want
    assert 200 < sum(want.values()) < 400


def test_symbols_are_not_folded(spark):
    assert len(set(quality.symbols("".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x10000, 16)])))[: 0xD800 - 0x20].tolist())) == 0xD800 - 0x20


def test_classifier_without_labels_keeps_all(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count() and got.where("NOT keep").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_classifier_tells_junk(spark, tmp_path):
    rng = random.Random(3)
    syllables = ["th", "er", "in", "on", "at", "es", "re", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    clean = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(300)]
    junk = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(20)]
    again = [" ".join([rng.choice(syllables)] * 200) for _ in range(5)]
    rows = [(k, t, "en", "s", len(t), *"abcde") for k, t in enumerate(clean + junk + again)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 300, 2)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(helpers.frame(spark, rows, tmp_path), labels).collect()}
    assert not any(got[k] for k in range(300, 325)) and sum(got[k] for k in range(300)) >= 285


# --- vectors

BAD = [(None, [1.0, 2.0]), (10_001, None), (10_002, [1.0, None, 0.0]), (10_003, [float("nan"), 0.0, 0.0]), (10_004, [float("inf"), 0.0, 0.0]), (10_005, [1.0]), (10_006, [0.0, 0.0, 0.0]), (10_007, [])]


def _vectors(spark, n, d=3, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    x[n // 2 :: 7] = x[n // 2]  # many copies of one vector
    rows = [(k, x[k].tolist()) for k in range(n)] + BAD
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x


def test_top_k_is_brute_force(spark):
    vectors, x = _vectors(spark, 700)
    got = {}
    for r in top_k.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = np.floor(1024 * x.astype(np.float64)).astype(int)
    zero = [(10_006, np.zeros(3, int))]
    for q in range(0, 700, 100):
        rows = [(-int(w[q] @ w[k]), k) for k in range(700) if k != q] + [(-int(w[q] @ v), k) for k, v in zero]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(sorted(rows)[:10])]
    assert set(got) == set(range(0, 700, 100))


def test_top_k_with_few_or_no_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k.top_k(few, few.where("vec_id % 100 = 0")).collect())
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    for none in (few.limit(0), few.select("vec_id", F.lit(None).cast("array<float>").alias("embedding")), few.select("vec_id", F.array().cast("array<float>").alias("embedding"))):
        assert top_k.top_k(none, none).count() == 0
        assert ann.build(none) is None


def test_sparse_terms_are_accumulated():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-3, 4, (5, 9)), rng.integers(-3, 4, (7, 9))
    a[:, 2], b[:, 4], a[1] = 0, 0, 0
    assert (top_k.accumulate(a, b) == a @ b.T).all()


def test_nearest_neighbours(spark):
    vectors, x = _vectors(spark, 1500, seed=4)
    index = ann.build(vectors)
    assert index.rows.count() == 1500
    got = {}
    for r in ann.search(index, index.rows.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits, y = 0, x.astype(np.float64)
    for q in range(0, 1500, 100):
        far = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = [k for k in np.lexsort((np.arange(1500), far)) if k != q][:10]
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert all(abs(s - far[k]) < 1e-12 and k != q for _, k, s in rows)
        assert [(s, k) for _, k, s in rows] == sorted((s, k) for _, k, s in rows)
        hits += len({k for _, k, _ in rows} & set(order))
    assert hits >= 0.9 * 150


def test_lanes_do_not_change_results(spark, monkeypatch):
    vectors, _ = _vectors(spark, 600, seed=5)
    one = ann.build(vectors)
    a = sorted(tuple(r) for r in ann.search(one, one.rows.where("vec_id % 100 = 0"), probe=1.0, rerank=1_000).collect())
    monkeypatch.setattr(ann, "LANE_ROWS", 20)
    many = ann.build(vectors)
    b = sorted(tuple(r) for r in ann.search(many, many.rows.where("vec_id % 100 = 0"), probe=1.0, rerank=1_000).collect())
    assert a == b and many.rows.select("list", "lane").distinct().count() > one.rows.select("list", "lane").distinct().count()


def _repeated(spark, n, d=3, seed=6):
    """Each row twice, and one vec_id forty times with other vectors."""
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    more = np.random.default_rng(seed + 1).normal(size=(40, d)).astype(np.float32) * 3
    rows = [(k, x[k].tolist()) for k in range(n)] * 2 + [(1, v.tolist()) for v in more]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), [(k, x[k]) for k in range(n)] + [(1, v) for v in more]


def _nearest_by_hand(rows, q, far):
    best = {}
    for k, v in rows:
        if k != q:
            best[k] = min(best.get(k, math.inf), far(v))
    return [(i + 1, k, s) for i, (s, k) in enumerate(sorted((s, k) for k, s in best.items())[:10])]


@pytest.mark.parametrize("strip", [64, 2_048])
def test_top_k_of_repeated_rows_is_brute_force(spark, monkeypatch, strip):
    monkeypatch.setattr(top_k, "STRIP", strip)
    vectors, rows = _repeated(spark, 300)
    got = {}
    for r in top_k.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(k, np.floor(1024 * v.astype(np.float64)).astype(int)) for k, v in rows]
    for q in (0, 100, 200):
        own = dict(whole[:300])[q]
        assert sorted(got[q]) == [(i, k, -s) for i, k, s in _nearest_by_hand(whole, q, lambda w: -int(own @ w))]


def test_nearest_neighbours_of_repeated_rows_are_brute_force(spark):
    vectors, rows = _repeated(spark, 300)
    index = ann.build(vectors)
    got = {}
    for r in ann.search(index, index.rows.where("vec_id % 100 = 0"), probe=1.0, rerank=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(k, v.astype(np.float64)) for k, v in rows]
    for q in (0, 100, 200):
        own = dict(whole[:300])[q]
        want = _nearest_by_hand(whole, q, lambda v: float(np.sqrt(((v - own) ** 2).sum())))
        assert [(i, k) for i, k, _ in sorted(got[q])] == [(i, k) for i, k, _ in want]
        assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(sorted(got[q]), want, strict=True))


def test_nearest_neighbours_of_few_rows_are_all_found(spark):
    x = np.random.default_rng(8).normal(size=(9, 3))
    index = ann.build(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert len(index.centroids) == 3
    got = {}
    for r in ann.search(index, index.rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(9):
        far = ((x - x[q]) ** 2).sum(1)
        assert sorted(got[q]) == [(i, k) for i, k in enumerate([k for k in np.argsort(far) if k != q], 1)]
