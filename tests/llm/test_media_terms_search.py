"""Media columns, the divergence audit and lexical search against plain versions on small hostile tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from cladeline.llm import divergence, iso_media, lexical_search, media, terms
from cladeline.llm.common import byte_batch
from tests.llm.helpers import LOWER, SCHEMA, documents, frame

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# terms


def test_terms_are_those_of_the_pattern(monkeypatch):
    import pyarrow as pa

    texts = [None, "", "  ", "a", "Aa aA ÄÖ ä1b2", "日本, x-y", "word " * 50, "long" * 100, "z" * 300 + " tail z", "end"]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(terms, "CHUNK", chunk)
        for pattern, table in ((LETTERS, terms.NO_LETTER), (ALNUM, terms.NO_LETTER_OR_DIGIT)):
            raw, offsets = byte_batch(pa.array(texts, pa.string()))
            got = defaultdict(Counter)
            for row, _, n, start, end in terms.counted(raw, offsets, table):
                words = terms.strings(raw, start, end).to_pylist()
                assert len(set(zip(row.tolist(), words, strict=True))) == len(row)
                for r, w, k in zip(row.tolist(), words, n.tolist(), strict=True):
                    got[r][w] += k
            want = {k: Counter(pattern.findall((t or "").translate(LOWER))) for k, t in enumerate(texts)}
            assert {k: v for k, v in want.items() if v} == dict(got)


# media


def _plain_boxes(data, a=0, b=None):
    """{path: content} of the first box of each path, by a plain recursion."""
    out, b = {}, len(data) if b is None else b
    while a < b:
        size, kind = struct.unpack(">I4s", data[a : a + 8])
        out.setdefault((kind,), data[a + 8 : a + size])
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            for k, v in _plain_boxes(data, a + 8, a + size).items():
                out.setdefault((kind, *k), v)
        a += size
    return out


def test_what_is_written_is_read_and_lies_where_the_tables_say():
    rng = np.random.default_rng(5)
    for frames in (1, 2, 31, 32, 33, 64, 100):
        payload = rng.integers(0, 256, frames * 576, dtype=np.uint8).tobytes()
        data = iso_media.write(payload, 24, 24, 25, 32, 16)
        movie = iso_media.read(data)
        (track,) = movie.tracks
        assert (movie.brand, track.handler, track.codec, track.width, track.height, track.timescale, track.duration) == ("isom", "vide", "raw ", 24, 24, 25, frames)
        assert iso_media.content(data, track) == payload and np.flatnonzero(track.sync).tolist() == list(range(0, frames, 16))
        for k, (o, s) in enumerate(zip(track.offsets.tolist(), track.sizes.tolist(), strict=True)):
            assert data[o : o + s] == payload[576 * k : 576 * k + 576]
        plain = _plain_boxes(data)
        assert plain[(b"mdat",)] == payload and struct.unpack(">II", plain[(b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz")][4:12]) == (576, frames)
    with pytest.raises(ValueError, match="do not fill"):
        iso_media.write(b"x", 24, 24, 25, 32, 16)


def _two_tracks():
    """A movie of two interleaved tracks, shifts, 4-bit sizes, a long size, an unknown box and the media first."""
    box, full = iso_media.box, iso_media.full
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    head = box(b"ftyp", b"mp42", u32(0))
    body = b"AAAABBBaaCCCCCb"
    mdat = (1).to_bytes(4) + b"mdat" + (16 + len(body)).to_bytes(8) + body
    at = len(head) + 16
    video = box(b"avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))
    audio = box(b"mp4a", bytes(16), struct.pack(">HH", 2, 16), bytes(4), u32(48_000 << 16))

    def trak(number, kind, entry, stbl, clock):
        mdia = box(b"mdia", full(b"hdlr", u32(0), kind, bytes(13)), clock, box(b"minf", box(b"stbl", full(b"stsd", u32(1), entry), *stbl)))
        return box(b"trak", full(b"tkhd", bytes(8), u32(number), bytes(68)), box(b"free", b"xyz"), mdia)

    v = [full(b"stts", u32(2, 2, 10, 1, 20)), full(b"ctts", u32(2, 1, 5), struct.pack(">Ii", 2, -5), version=1), full(b"stss", u32(1, 1)), full(b"stsc", u32(2, 1, 2, 1, 2, 1, 1)), full(b"stsz", u32(0, 3, 4, 3, 5)), full(b"co64", u32(2), struct.pack(">QQ", at, at + 9))]
    a = [full(b"stts", u32(1, 2, 1024)), full(b"stsc", u32(1, 1, 1, 1)), full(b"stz2", bytes(3), b"\4", u32(2), b"\x21"), full(b"stco", u32(2, at + 7, at + 14))]
    moov = box(b"moov", full(b"mvhd", bytes(16), u32(600), (1800).to_bytes(8), bytes(80), version=1), trak(1, b"vide", video, v, full(b"mdhd", bytes(8), u32(600, 40), bytes(4))), trak(2, b"soun", audio, a, full(b"mdhd", bytes(8), u32(48_000, 2048), bytes(4))))
    return head + mdat + moov


def test_interleaved_tracks_shifts_and_narrow_sizes():
    data = _two_tracks()
    movie = iso_media.read(data)
    v, a = movie.tracks
    assert (movie.brand, movie.timescale, movie.duration) == ("mp42", 600, 1800)
    assert iso_media.content(data, v) == b"AAAABBBCCCCC" and iso_media.content(data, a) == b"aab"
    assert (v.codec, v.width, v.height, (v.times + v.shifts).tolist(), v.sync.tolist()) == ("avc1", 640, 360, [5, 5, 15], [True, False, False])
    assert (a.codec, a.channels, a.rate, a.sizes.tolist(), a.sync.tolist()) == ("mp4a", 2, 48_000, [2, 1], [True, True])


def test_fragments_continue_their_track():
    box, full = iso_media.box, iso_media.full
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    head = box(b"ftyp", b"iso5", u32(0))
    trak = box(b"trak", full(b"tkhd", bytes(8), u32(7), bytes(68)), box(b"mdia", full(b"mdhd", bytes(8), u32(1000, 0), bytes(4)), full(b"hdlr", u32(0), b"vide", bytes(13))))
    moov = box(b"moov", trak, box(b"mvex", full(b"trex", u32(7, 1, 40, 3, 0x10000))))

    def moof(time, extra):
        make = lambda offset: box(b"moof", box(b"traf", full(b"tfhd", u32(7), flags=0x20000), full(b"tfdt", u32(time)), full(b"trun", u32(2, offset, 0), extra, flags=0x205)))
        return make(len(make(0)) + 8)

    data = head + moov
    for time, body in ((0, b"aabbb"), (80, b"ccddd")):
        data += moof(time, u32(2, 3)) + box(b"mdat", body)
    (track,) = iso_media.read(data).tracks
    assert iso_media.content(data, track) == b"aabbbccddd"
    assert (track.times.tolist(), track.sync.tolist(), track.duration) == ([0, 40, 80, 120], [True, False, True, False], 160)


def test_broken_files_have_faults_and_cost_nothing():
    good = iso_media.write(bytes(576 * 40), 24, 24, 25, 32, 16)
    for cut in range(0, 700, 7):
        with pytest.raises(iso_media.Fault):
            iso_media.read(good[:cut])
    rng = np.random.default_rng(1)
    for _ in range(400):  # one byte of the boxes changed: read, or refused, and never anything else
        bad = bytearray(good)
        bad[int(rng.integers(0, 700))] = int(rng.integers(0, 256))
        try:
            for track in iso_media.read(bytes(bad)).tracks:
                iso_media.content(bytes(bad), track)
        except iso_media.Fault:
            pass
    claims = good.replace(struct.pack(">II", 576, 40), struct.pack(">II", 1, 0xFFFFFFFF))
    with pytest.raises(iso_media.Fault, match="samples of 1 bytes"):
        iso_media.read(claims)


def test_op11_round_trip(spark, tmp_path):
    rows = documents()
    frame(spark, rows, tmp_path)
    got = media.op11_media_columns(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t, *_ in rows:
        body = (t or "").encode()
        padded = body + b"\xff" * (-len(body) % 576 or (0 if body else 576))
        want[(d, len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))] += 1
    assert want == Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    assert all(r.fault is None and r.media_bytes > r.payload_bytes for r in got)
    texts = {d: t for d, t, *_ in rows if Counter(x[0] for x in rows)[d] == 1}
    same = defaultdict(set)
    for r in got:
        if r.doc_id in texts:
            same[texts[r.doc_id] or ""].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())


def test_media_columns_of_any_files(spark):
    rows = [(1, _two_tracks()), (2, None), (3, b""), (4, b"no media at all"), (1, _two_tracks())]
    got = media.media_columns(spark.createDataFrame(rows, "brand long, media binary"), "brand").collect()
    assert len(got) == 5 and sorted(r.fault is None for r in got) == [False, False, True, True, True]
    first = next(r for r in got if r.key == 1)
    assert [(t.codec, t.samples, [(k.size, k.time) for k in t.keyframes]) for t in first.tracks] == [("avc1", 3, [(4, 5)]), ("mp4a", 2, [(2, 0), (1, 1024)])]
    assert media.media_columns(spark.createDataFrame([], "brand long, media binary"), "brand").count() == 0


# divergence


def _audit(rows, least):
    """rows (text, lang, source) -> the audit's rows, by the definition."""
    docs = [((t or ""), l or "", s or "") for t, l, s in rows]
    df, count = Counter(), Counter()
    for t, l, s in docs:
        found = Counter(LETTERS.findall(t.translate(LOWER)))
        for w, k in found.items():
            df[l, w] += 1
            count[l, s, w] += k
    out = []
    for lang in {l for _, l, _ in docs}:
        kept = [w for (l, w), k in df.items() if l == lang and k >= least]
        sources = sorted({s for _, l, s in docs if l == lang})
        v = len(kept)
        floor = lambda c, n: 1 + math.floor(Fraction(10**9 * (c + 5), n + 5 * v))  # noqa: B023, E731
        n = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: floor(count[lang, s, w], n[s]) for w in kept} for s in sources}
        q = {w: floor(sum(count[lang, s, w] for s in sources), sum(n.values())) for w in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            over = [(w, p[s][w] - q[w]) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", over, 50)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, x, k + 1) for k, (w, x) in enumerate(found[:most])]
    return sorted(out)


def _mixed(seed=4, n=1_500, sources=14):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(10)] + ["Éa", "日本"]
    rows = []
    for _ in range(n):
        s = int(rng.integers(0, sources)) if rng.random() > 0.4 else 0
        own = rng.integers(0, len(words), int(rng.integers(0, 60)))
        own = own if rng.random() < 0.5 else own // (s + 1)
        rows.append((" ".join(words[k] for k in own), ["en", "de", None][int(rng.integers(0, 3))], f"s{s}" if s != 3 else None))
    return rows + [(None, "en", "s1"), ("", "it", "alone"), (None, "it", "other"), (None, None, None), ("12 34 __", "en", "numbers only")] + [rows[0]] * 3


def test_audit_by_definition(spark, tmp_path, monkeypatch):
    rows = _mixed()
    docs = spark.createDataFrame([(t, l, s, 1, "x", 2) for t, l, s in rows], "text string, lang string, source string, count int, term string, total int")
    want = _audit(rows, 30)
    assert len({r[3] for r in want if r[2] == "term"}) > 50
    out = divergence.audit(docs)
    assert sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()) == want
    for name, value in (("BLOCK", 4), ("TILE_CELLS", 300), ("HELD", 100), ("DENSE_TERMS", 7)):  # many blocks, tiles and parts
        monkeypatch.setattr(divergence, name, value)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == want


def test_heavy_and_light_sums_are_the_same_number():
    rng = np.random.default_rng(0)
    groups, n = 9, 40
    cells = [(g, t) for t in range(n) for g in range(groups) if rng.random() < rng.choice([0.1, 0.9])]
    at, term = (np.array(x, np.int64) for x in zip(*cells, strict=True))
    term = np.unique(term, return_inverse=True)[1]
    p, p0 = rng.integers(1, 10**9, len(at)), rng.integers(1, 10**6, groups)
    some = (np.array([0, 2, 5]), np.array([1, 2, 3, 8]))
    for left, right in (some, (np.arange(groups),) * 2):
        full = np.repeat(p0[:, None], term.max() + 1, axis=1)
        full[at, term] = p
        apart = np.abs(full[left][:, None] - full[right][None]).sum(-1) - full.shape[1] * np.abs(p0[left][:, None] - p0[right])
        assert (divergence._dense(at, term, p, p0, left, right) == apart).all()
        sparse = divergence._sparse(at, term, p, p0, left, right)
        off = left[:, None] != right
        assert (sparse[off] == apart[off]).all()


def test_shares_beyond_64_bits():
    c, n = 80_000_000_000_000, 90_000_000_000_007
    assert divergence._share(np.array([c]), np.array([n]))[0] == 1 + 10**9 * (c + 5) // n


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


# search


def _search(rows, items, k=10):
    docs = [(d, Counter(ALNUM.findall((t or "").translate(LOWER)))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out, by_item = [], defaultdict(Counter)
    for i, t in set(items):
        by_item[i] += Counter(ALNUM.findall((t or "").translate(LOWER)))
    for i, query in by_item.items():
        if i is None:
            continue
        scores = []
        for d, c, length in docs:
            m = 25 + 75 * length * n // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, x in query.items() if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda x: x[:2])


def test_search_by_definition(spark, tmp_path, monkeypatch):
    rows = documents()
    docs = frame(spark, rows, tmp_path)
    items = [(1, "The stone3 of the RING4"), (2, None), (3, ""), (4, "nothing that matches zzz"), (5, "日本7 naïve2 naïve2"), (6, rows[0][1] or "one"), (5, "water1"), (None, "one"), (1, "The stone3 of the RING4"), (7, "one two three four five")]
    frame_items = spark.createDataFrame([(i, t, 0, "r") for i, t in items], "item_id long, text string, rank int, score string")
    want = _search([(d, t) for d, t, *_ in rows], items)
    assert len(want) > 30
    got = lambda: sorted((tuple(r) for r in lexical_search.search(docs, frame_items).collect()), key=lambda x: x[:2])
    assert got() == want
    for name, value in (("BLOCK_TERMS", 3), ("ENTRIES", 5), ("HELD_KEYS", 10)):  # several rounds, short runs
        monkeypatch.setattr(lexical_search, name, value)
    assert got() == want


def test_search_of_nothing(spark, tmp_path):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(frame(spark, documents(), tmp_path), items.limit(0)).count() == 0


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    for top in (10, 1 << 17, 1 << 40):
        keys = rng.integers(0, top, 5_000)
        assert (lexical_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_short_runs_give_what_long_ones_do(monkeypatch):
    """Constants that only tasks read: few keys held, few entries sorted at once, few counts, few terms to a dense array."""
    import pyarrow as pa

    rows = [(d, t) for d, t, *_ in documents() if t and len(t) < 5_000] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    raw, offsets = byte_batch(pa.array(["the of ring3 stone4 one two three four five"]))
    vocabulary = np.unique(np.concatenate([h for _, h, *_ in terms.counted(raw, offsets, terms.NO_LETTER_OR_DIGIT)]))
    begins, items = np.arange(0, 2 * len(vocabulary) + 1, 2), np.tile([0, 1], len(vocabulary))

    def found():
        postings = pa.Table.from_batches(list(lexical_search._postings(vocabulary)([batch.slice(0, 20), batch.slice(20)])))
        kind = postings.column("kind").to_numpy()
        assert (kind == lexical_search.COUNTS).sum() == 1
        run = lexical_search._scored(np.array([7, 9]), begins, items, np.ones(len(items), np.int64), np.full(len(vocabulary), 1_000), len(rows), 5_000, 3)
        return postings.to_pylist(), pa.Table.from_batches(list(run(postings.filter(pa.array(kind == 0)).to_batches()))).to_pylist()

    whole = found()
    monkeypatch.setattr(lexical_search, "HELD_KEYS", 3)
    monkeypatch.setattr(lexical_search, "ENTRIES", 5)
    assert found() == whole and len(whole[1]) == 6

    texts = pa.RecordBatch.from_arrays([pa.array([["en", "de"][k % 2] for k in range(len(rows))]), pa.array([f"s{k % 3}" for k in range(len(rows))]), batch.column("text")], names=["lang", "source", "text"])

    def counts():
        out = Counter()
        for part in divergence._counting([texts.slice(0, 15), texts.slice(15)]):
            for r in part.to_pylist():
                out[r["lang"], r["source"], r["term"]] += 1_000_000 * r["docs"] + r["count"]
        return out

    whole = counts()
    monkeypatch.setattr(divergence, "HELD", 10)
    assert counts() == whole and len(whole) > 50
    rng = np.random.default_rng(1)
    at, term = np.repeat(np.arange(5), 40), np.tile(np.arange(40), 5)
    p, p0 = rng.integers(1, 10**9, 200), rng.integers(1, 10**6, 5)
    whole = divergence._dense(at, term, p, p0, np.arange(5), np.arange(5))
    monkeypatch.setattr(divergence, "DENSE_TERMS", 7)
    assert (divergence._dense(at, term, p, p0, np.arange(5), np.arange(5)) == whole).all()
