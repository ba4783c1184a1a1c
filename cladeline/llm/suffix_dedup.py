"""Removal of byte strings that documents with smaller ids hold too, found with suffix arrays.

1. Every 50-byte window is named by its anchor: of the 24-byte strings in it, the one with the smallest
   hash, the first of equals.  Equal windows have equal anchors.  Anchors that occur in one document only
   are dropped with their windows (shared_keys); this can drop no window that occurs twice.
2. For each remaining anchor of a document, the piece of text that its windows cover goes to the shard of
   the anchor.  Equal pieces of a task go once, with the smallest doc_id; the others lose their windows.
3. A shard takes equal pieces together, and where an anchor has several different pieces, builds suffix
   arrays over these, part by part: Larsson-Sadakane refinement, Kasai's common prefixes; parts meet by binary search.
   A window is removed from a document if a smaller doc_id holds it.
4. Removed windows meet the text of their document again and are cut out.

Texts are kept compressed by block and not shuffled; what is found goes to them (steps 2 and 4).

What is shuffled beyond step 1 is text that other documents may hold too, so the work follows the
repeated part of the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_keys as keys
from .blocks import located, runs, stored, unpacked
from .common import Scratch, byte_batch, partitions, table, trimmed
from .shingles import mixed
from .suffix_array import merge_minima, window_groups, windows_at

WIDTH = 50
GRAM = 24
SPAN = WIDTH - GRAM + 1
#: Bytes of text handled at once; longer texts are cut with an overlap.
CHUNK = 1 << 18
#: Bytes of pieces a task gathers before it sends them, bytes of a shard, and bytes of one suffix array.
SEND_BYTES, SHARD_BYTES, PART_BYTES = 2 << 20, 2 << 20, 1 << 20
#: Rows of a block of documents.
BLOCK_ROWS = 1_024
#: Bytes of text to an anchor, and bytes of an anchor's piece, about.
BYTES_PER_ANCHOR, PIECE_BYTES = 14, 64

_rng = np.random.default_rng(20_260_102)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 2**64, 5, dtype=np.uint64) | np.uint64(1)
_INDEX = np.uint64((1 << 18) - 1)
#: No UTF-8 text holds this byte.
_GAP = 0xFF


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position."""
    h = _BYTE[raw]
    for k in range(4):
        s = 1 << k
        h = h[:-s] * _STEP[k] + h[s:]
    h16, h8 = h, None
    h = _BYTE[raw]
    for k in range(3):
        s = 1 << k
        h = h[:-s] * _STEP[k] + h[s:]
    h8 = h
    m = len(raw) - GRAM + 1
    return mixed(h16[:m] * _STEP[4] + h8[16 : 16 + m])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window: the position of its anchor.  Per position: the hash."""
    h = _grams(raw)
    v = (h & ~_INDEX) | np.arange(len(h), dtype=np.uint64)
    for s in (1, 2, 4, 8):
        v = np.minimum(v[:-s], v[s:])
    m = len(raw) - WIDTH + 1  # v covers 16 grams
    return (np.minimum(v[:m], v[SPAN - 16 : SPAN - 16 + m]) & _INDEX).astype(np.int64), h


def pieces(raw: np.ndarray, offsets: np.ndarray):
    """(row, first window, last window, name) arrays of the runs of windows with one anchor, chunk by chunk.

    Windows are counted from the start of their text.  An anchor's name is its hash mixed once more: anchors have
    the least hash of their window, so their hashes lie low, and shards are dealt by leading bits.
    """
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        base, end = int(offsets[a]), int(offsets[b])
        for x in range(base, max(base + 1, end - WIDTH + 1), CHUNK - WIDTH + 1):
            y = min(end, x + CHUNK)
            if y - x < WIDTH:
                continue
            anchor, h = anchors(raw[x:y])
            start = np.arange(x, x + len(anchor))
            row = np.searchsorted(offsets, start, "right") - 1
            whole = start + WIDTH <= offsets[row + 1]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])] & whole
            first = np.flatnonzero(new)
            if not len(first):
                continue
            last = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True])
            yield row[first], start[first] - offsets[row[first]], start[last] - offsets[row[first]], mixed(h[anchor[first]])
        a = b


def _emit(shards: int):
    def run(batches):
        packer = keys.Packer(shards)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            raw, offsets = byte_batch(batch.column("text"))
            for row, _, _, h in pieces(raw, offsets):
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
                yield from packer.add(h[new], ids[row[new]])
        yield from packer.flush()
        trimmed()

    return run


def _finish(rows: pa.Table) -> pa.Table:
    k, d, _ = keys.meet(rows)
    return pa.table([pa.array(d), pa.array(k.view(np.int64))], names=["doc", "key"])


_SENT = "shard int, block long, hash binary, doc binary, rid binary, at binary, size binary, body binary"
_SENT_TYPES = [pa.int32(), pa.int64()] + [pa.binary()] * 6


def _send(shards: int):
    """Sends a block's pieces with shared anchors to their shards; pieces already known to be lost go without their text."""

    def packed(block: int, held: dict, lost: list) -> list[tuple]:
        press = zstandard.ZstdCompressor(level=3)
        by_shard: dict[int, list] = {}
        for body, (h, doc, places) in held.items():
            s = ((h >> 32) * shards) >> 32
            for rid, at in places:
                by_shard.setdefault(s, []).append((h, doc, rid, at, len(body), body))
        rows = []
        for s, items in by_shard.items():
            h, doc, rid, at, size, body = zip(*items, strict=True)
            rows.append((s, block, np.array(h, np.uint64).tobytes(), keys.planes(np.array(doc, np.int64)), keys.planes(np.array(rid, np.int32)), keys.planes(np.array(at, np.int64)), np.array(size, np.uint8).tobytes(), press.compress(b"".join(body))))
        if lost:
            rid, at, size = zip(*lost, strict=True)
            rows.append((block % shards, block, b"", b"", keys.planes(np.array(rid, np.int32)), keys.planes(np.array(at, np.int64)), np.array(size, np.uint8).tobytes(), b""))
        return rows

    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        known = {doc: np.unique(k.values.to_numpy().view(np.uint64)) for doc, k in zip(shared.column("doc").to_pylist(), shared.column("keys"), strict=True)}
        block = (texts if len(texts) else shared).column("block")[0].as_py()
        held: dict[bytes, list] = {}
        lost: list[tuple] = []
        held_size = 0
        for ids, rids, bodies in unpacked(texts):
            mine = [k for k, doc in enumerate(ids) if doc in known and bodies[k]]
            ids, rids = [ids[k] for k in mine], [rids[k] for k in mine]
            raw, offsets = byte_batch(pa.array([bodies[k] for k in mine], pa.string()))
            data = raw.tobytes()
            for row, first, last, h in pieces(raw, offsets):
                for a, b in runs(row):
                    r = int(row[a])
                    own, hashes = known[ids[r]], h[a:b] & keys.KEPT
                    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                    doc, rid, base = ids[r], rids[r], int(offsets[r])
                    for k in (np.flatnonzero(own[at] == hashes) + a).tolist():
                        x, y = int(first[k]), int(last[k]) + WIDTH
                        body = data[base + x : base + y]
                        have = held.get(body)
                        if have is None:
                            held[body] = [int(h[k]), doc, [(rid, x)]]
                            held_size += y - x
                        elif doc > have[1]:
                            lost.append((rid, x, y - x))
                        elif doc == have[1]:
                            have[2].append((rid, x))
                        else:
                            lost += [(r_, p, y - x) for r_, p in have[2]]
                            held[body] = [int(h[k]), doc, [(rid, x)]]
                if held_size > SEND_BYTES or len(lost) > 25_000:
                    rows += packed(block, held, lost)
                    held, lost, held_size = {}, [], 0
        rows += packed(block, held, lost)
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        return trimmed(pa.table([pa.array(c, t) for c, t in zip(columns, _SENT_TYPES, strict=True)], names=["shard", "block", "hash", "doc", "rid", "at", "size", "body"]))

    return run


_CUTS = "block long, rid binary, start binary, stop binary"


def _settle(rows: pa.Table) -> pa.Table:
    """Removed stretches of one shard's pieces."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    hashes, docs, blocks, rids, ats, bodies = [], [], [], [], [], []
    press = zstandard.ZstdDecompressor()
    for row in range(len(rows)):
        cell = lambda c, row=row: rows.column(c)[row].as_buffer()
        rid, at = keys.unplanes(cell("rid"), np.int32), keys.unplanes(cell("at"), np.int64)
        size = np.frombuffer(cell("size"), np.uint8).astype(np.int64)
        block = np.full(len(rid), rows.column("block")[row].as_py())
        if not len(cell("hash")):
            out.append((block, rid, at, at + size))
            continue
        hashes.append(np.frombuffer(cell("hash"), np.uint64))
        docs.append(keys.unplanes(cell("doc"), np.int64))
        blocks.append(block)
        rids.append(rid)
        ats.append(at)
        body, stops = press.decompress(cell("body")), np.cumsum(size).tolist()
        bodies += [body[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
    if bodies:
        h, doc, block, rid, at = (np.concatenate(x) for x in (hashes, docs, blocks, rids, ats))
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(b, len(number)) for b in bodies])
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc)
        size = np.array([len(b) for b in number])
        lost = doc > least[kind]
        out.append((block[lost], rid[lost], at[lost], at[lost] + size[kind[lost]]))
        kind_hash = np.zeros(len(number), np.uint64)
        kind_hash[kind] = h
        _, inverse, count = np.unique(kind_hash, return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[inverse] > 1)
        strings = list(number)
        live = np.flatnonzero(~lost)
        live = live[np.argsort(kind[live], kind="stable")]
        live_kind = kind[live]
        parts, start = [], 0
        while start < len(several):
            stop = start + max(1, int(np.searchsorted(np.cumsum(size[several[start:]] + 1), PART_BYTES)))
            parts.append(several[start:stop])
            start = stop
        built = []
        for part in parts:
            text = np.frombuffer(b"".join(strings[k] + b"\xff" for k in part), np.uint8)
            ends = np.cumsum(size[part] + 1) - 1
            starts = ends - size[part]
            where, group = window_groups(text, starts, ends, WIDTH)
            new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            owner = np.searchsorted(ends, where, "right")
            value = np.minimum.reduceat(least[part][owner], new)
            name = windows_at(text, where[new], WIDTH) if len(parts) > 1 else None
            built.append((starts, where, owner, np.diff(np.r_[new, len(where)]), name, value))
        best = merge_minima([(b[4], b[5]) for b in built]) if len(parts) > 1 else [b[5] for b in built]
        for part, (starts, where, owner, widths, _, _), value in zip(parts, built, best, strict=True):
            gone = np.repeat(value, widths) < least[part][owner]
            where, owner = where[gone], owner[gone]
            order = np.argsort(where)
            where, owner = where[order], owner[order]
            if not len(where):
                continue
            new = np.flatnonzero(np.r_[True, where[1:] != where[:-1] + 1])
            a = where[new] - starts[owner[new]]
            b = where[np.r_[new[1:], len(where)] - 1] - starts[owner[new]] + WIDTH
            which = part[owner[new]]
            lo, hi = np.searchsorted(live_kind, which, "left"), np.searchsorted(live_kind, which, "right")
            each = hi - lo
            take = live[np.repeat(lo - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())]
            out.append((block[take], rid[take], at[take] + np.repeat(a, each), at[take] + np.repeat(b, each)))
    if not sum(len(c[0]) for c in out):
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=["block", "rid", "start", "stop"])
    block, rid, start, stop = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((start, rid, block))
    block, rid, start, stop = block[order], rid[order].astype(np.int32), start[order], stop[order]
    packed = [(int(block[a]), *(keys.planes(np.ascontiguousarray(c[a:b])) for c in (rid, start, stop))) for a, b in runs(block)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "rid", "start", "stop"])


def _spans(cuts: np.ndarray) -> np.ndarray:
    """Sorted disjoint, not touching stretches that cover the same bytes."""
    cuts = cuts[np.argsort(cuts[:, 0])]
    reach = np.maximum.accumulate(cuts[:, 1])
    new = np.flatnonzero(np.r_[True, cuts[1:, 0] > reach[:-1]])
    return np.stack([cuts[new, 0], reach[np.r_[new[1:], len(cuts)] - 1]], axis=1)


def _whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of [a, b) that is whole characters."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


_DONE = "doc_id long, block long, rid int, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_DONE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _cut(with_text: bool):
    def run(texts: pa.Table, cuts: pa.Table) -> pa.Table:
        if len(cuts):
            rid = np.concatenate([keys.unplanes(x.as_buffer(), np.int32) for x in cuts.column("rid")])
            spans = np.stack([np.concatenate([keys.unplanes(x.as_buffer(), np.int64) for x in cuts.column(c)]) for c in ("start", "stop")], axis=1)
            order = np.argsort(rid, kind="stable")
            rid, spans = rid[order], spans[order]
        else:
            rid, spans = np.zeros(0, np.int32), np.zeros((0, 2), np.int64)
        at = {int(rid[a]): (a, b) for a, b in runs(rid)}
        rows = []
        for ids, rids, bodies in unpacked(texts):
            for doc, r, body in zip(ids, rids, bodies, strict=True):
                data = (body or "").encode()
                mine = _spans(spans[slice(*at[r])]).tolist() if r in at else []
                kept = _without(data, mine)
                text = body
                if mine and with_text:
                    text = _without(data, [w for x, y in mine if (w := _whole_characters(data, x, y))[0] < w[1]]).decode()
                rows.append((doc, r, len(data), len(data) - len(kept), len(mine), hashlib.sha256(kept).hexdigest(), text))
        block = texts.column("block")[0].as_py() if len(texts) else 0
        doc, r, n, gone, k, sha, text = zip(*rows, strict=True) if rows else [()] * 7
        columns = [doc, [block] * len(rows), r, n, gone, k, sha, text]
        names = ["doc_id", "block", "rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        return trimmed(pa.table([pa.array(c, t) for c, t in zip(columns, _DONE_TYPES, strict=True)][: 7 + with_text], names=names[: 7 + with_text]))

    return run


def _without(data: bytes, spans: list) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def repeated_bytes(docs: DataFrame, text: str = "text", with_text: bool = False, store: Scratch | None = None) -> DataFrame:
    """doc_id, block, rid, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text of every row of
    ``docs``; block and rid name the row (blocks.located with BLOCK_ROWS).

    Every byte goes that is covered by a 50-byte string that also starts in a document with a smaller doc_id, judged on
    the texts as they came.  kept_sha256 is of the remaining bytes; kept_text keeps whole those characters of which
    only a part would go, and leaves a null text null.  Null and short texts, texts without a doc_id, and rows with the
    same doc_id among themselves lose nothing.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    store = store or Scratch(spark, "suffix")
    flat = located(docs, store, BLOCK_ROWS, [F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")])
    long = flat.where(f"doc_id is not null and octet_length(text) >= {WIDTH}")
    n, size = keys.text_bytes(long)
    shards = keys.shards_for(size // BYTES_PER_ANCHOR, partitions(spark))
    shared = store.put(keys.shared(long.select("doc_id", "text"), _emit, lambda rows: trimmed(_finish(rows)), "doc long, key long", shards), "shared")
    shards = max(partitions(spark), shared.count() * PIECE_BYTES // SHARD_BYTES + 1)
    by_doc = shared.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    by_block = by_doc.join(flat.select(F.col("doc_id").alias("doc"), "block").distinct(), "doc").select("block", "doc", "keys")
    body = stored(flat, ["doc_id", "rid", "text"], store, max(partitions(spark), n // (2 * BLOCK_ROWS)))
    sent = body.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(_send(shards), _SENT)
    cuts = store.put(sent.groupBy("shard").applyInArrow(lambda rows: trimmed(_settle(rows)), _CUTS), "cuts")
    store.drop(shared)
    schema = _DONE + ", kept_text string" * with_text
    return body.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_cut(with_text), schema)


def dedup_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``; see repeated_bytes()."""
    return repeated_bytes(docs, text).drop("block", "rid")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM d, unnest(generate_series(1, len(h) // 2 - 49)) t(i)),
m AS (SELECT s, min(doc_id) AS first FROM p GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i FROM p JOIN m USING (s) WHERE first < doc_id),
y AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM x),
z AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM y),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM z GROUP BY 1, 2),
kept AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
         UNION ALL SELECT doc_id, 1, min(a) FROM spans GROUP BY 1),
t AS (SELECT k.doc_id, string_agg(CASE WHEN k.b IS NULL THEN substr(h, 2 * k.a - 1) ELSE substr(h, 2 * k.a - 1, 2 * (k.b - k.a)) END, '' ORDER BY k.a) AS rest FROM kept k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY 1) r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
