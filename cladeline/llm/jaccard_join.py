"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Exact, without comparing all pairs:

1. In any fixed order of all shingles, two sets that link share several of their first ones (prefix_length).
   Those prefix shingles meet by shared_keys; most are held by one document and fall away, and so does
   a document with too few left to link (least_shared).
   Shingles found often in a bounded sample come last in the order.  The sample moves work only;
   whatever it holds, the prefixes of linked sets meet.
2. Each document is tested against the two documents that are the most central ones of most of its FEW smallest
   shared shingles, which joins groups of near copies without forming their pairs.
3. Shingles form size-banded tiles: a document is at home in
   the band of its size and a guest in the one below, and a tile compares its homes with its homes and
   guests of other components.  Hashed bitmaps bound the overlap from above by bit counts, and what the
   bound lets through is decided by intersecting the sorted shingle arrays.  First, tiles of the FEW offer pairs that
   would span their components; then tiles of all shingles that still hold several components, of documents
   with enough of these, offer all pairs that are left.
4. Components of all links.

Equal sets of a task count once from the start.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared_keys as keys
from .common import Scratch, byte_batch, partitions, small, table, trimmed
from .components import components
from .shingles import enough, folded, least_shared, prefix_length, shingle_sets, signature

#: Documents whose shingles set the order, and how many of the most frequent come last.  Bounds, not limits on what is found.
ORDER_SAMPLE = 4_096
ORDER_KEYS = 65_536
#: Central documents that a document is tested against at first.
LEADERS = 2
#: First shared shingles of a document by which a pair that meets at many of them is offered at one.
LEAD = 8
#: Smallest shared shingles of a document by which components are joined before all are looked at.
FEW = 8
#: least_shared() of n, in SQL.
_LEAST = "1 + (3 * n div 4) div 10"
#: Rows of a tile task, about, and bands of sizes whose tiles lie together.
TILE_ROWS, BANDS = 10_000, 8
#: Pairs compared at once.
PAIRS = 100_000
#: Bytes of text (as UTF-8) that yield one prefix shingle, about: 5.5 a word, a third of the shingles.
BYTES_PER_KEY = 15


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles in at least one of a thousand documents of a bounded sample, the most frequent ORDER_KEYS, sorted."""
    if n > ORDER_SAMPLE:
        docs = docs.where(F.pmod(F.xxhash64(F.lit("order"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * ORDER_SAMPLE / n))

    def emit(batches):
        for batch in batches:
            for _, s in shingle_sets(*byte_batch(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array(_as_long(s))], names=["token"])

    counts = docs.select("text").mapInArrow(emit, "token long").groupBy("token").count().where(F.col("count") >= max(4, ORDER_SAMPLE // 1_000))
    top = counts.orderBy(F.desc("count"), "token").limit(ORDER_KEYS).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _emit(frequent: np.ndarray):
    def emit(shards: int):
        def run(batches):
            packer = keys.Packer(shards)
            seen: dict[bytes, int] = {}
            for batch in batches:
                ids = batch.column("doc_id")
                null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
                ids = ids.fill_null(0).to_numpy().astype(np.int64)
                sizes, reps = np.zeros(len(ids), np.int64), ids.copy()
                some, owners, sigs = [], [], [b""] * len(ids)
                early = np.full(len(ids), -1, np.int64)
                for k, s in shingle_sets(*byte_batch(batch.column("text"))):
                    sizes[k] = len(s)
                    if not len(s) or null[k]:
                        continue
                    reps[k] = rep = seen.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), int(ids[k]))
                    if rep != ids[k]:
                        continue
                    sigs[k] = signature(s)
                    rare = len(s)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        late = frequent[at] == s
                        if late.any():
                            rare -= int(np.count_nonzero(late))
                            s = np.concatenate([s[~late], s[late]])
                    some.append(s[: prefix_length(len(s))])
                    if rare <= len(some[-1]):
                        early[k] = rare
                    owners.append(np.full(len(some[-1]), ids[k]))
                widths = np.array([len(x) for x in sigs], np.int64)
                yield packer.note(keys.planes(ids), keys.planes(sizes) + keys.planes(reps) + keys.planes(early) + keys.planes(widths) + null.tobytes() + b"".join(sigs))
                if some:
                    yield from packer.add(np.concatenate(some), np.concatenate(owners))
            yield from packer.flush()
            trimmed()

        return run

    return emit


_MET = "doc long, token long, n long, rep long, early long, sig binary"


def _finish(rows: pa.Table) -> pa.Table:
    k, d, notes = keys.meet(rows)
    parts = [(pa.array(d), pa.array(_as_long(k)), *[pa.nulls(len(d), pa.int64()) for _ in range(3)], pa.nulls(len(d), pa.binary()))]
    for a, b in notes:
        m = len(a) // 8
        ids, sizes, reps, early, widths = (keys.unplanes(x, np.int64) for x in (a, *(b[8 * i * m : 8 * (i + 1) * m] for i in range(4))))
        null, stops = np.frombuffer(b[32 * m : 33 * m], bool), np.cumsum(widths) + 33 * m
        sigs = [b[y - w : y] or None for y, w in zip(stops.tolist(), widths.tolist(), strict=True)]
        parts.append((pa.array(ids, mask=null), pa.nulls(m, pa.int64()), pa.array(sizes), pa.array(reps, mask=null), pa.array(early), pa.array(sigs, pa.binary())))
    return pa.table([pa.chunked_array(list(c)) for c in zip(*parts, strict=True)], names=["doc", "token", "n", "rep", "early", "sig"])


def _sets(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy().astype(np.int64)
        rows = [(int(ids[k]), s.tobytes()) for k, s in shingle_sets(*byte_batch(batch.column("text")))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["doc", "shingles"])


def _bound(a: np.ndarray, b: np.ndarray, na, nb):
    """No fewer shingles than two sets with these bitmaps can share."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def _by_bitmap(batches):
    for batch in batches:
        x = batch.to_pydict()
        keep = []
        for k, (na, nb, sa, sb) in enumerate(zip(x["na"], x["nb"], x["sa"], x["sb"], strict=True)):
            a, b = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            size = min(len(a), len(b))
            if enough(int(_bound(folded(a, size), folded(b, size), na, nb)), na, nb):
                keep.append(k)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _by_shingles(batches):
    for batch in batches:
        pa_, pb_, keep = batch.column("xa"), batch.column("xb"), []
        for k in range(len(batch)):
            a, b = np.frombuffer(pa_[k].as_buffer(), np.uint64), np.frombuffer(pb_[k].as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            if enough(int(np.count_nonzero(b[at] == a)), len(a), len(b)):
                keep.append(k)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _within_bound(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and bitmaps do not rule a link out."""
    side = lambda x: sigs.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_by_bitmap, "a long, b long").distinct()


def _shingle_sets(held: DataFrame, docs: DataFrame, store: Scratch, buckets: int) -> DataFrame:
    """doc, shingles of the documents that hold a shared shingle."""
    ids = store.put(held.select(F.col("doc").alias("doc_id")).distinct(), "holders")
    picked = docs.join(small(ids), "doc_id", "left_semi").select("doc_id", "text")
    sets = store.put_by(picked.mapInArrow(_sets, "doc long, shingles binary"), "doc", buckets, "sets")
    store.drop(ids)
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, store: Scratch) -> DataFrame:
    """The pairs (a, b) that link, by their shingles."""
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("shingles").alias(f"x{x}"))
    return store.put(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(_by_shingles, "a long, b long").distinct(), "links")


class _Forest:
    """Which components a tile's pairs would join if all of them linked."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[y] = x
        return x != y


def _spans(group: np.ndarray, home: np.ndarray, n: np.ndarray, alone: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(left, right, start, count): row left[k] of a tile is to be compared with the rows right[start[k]], ..., count[k] of them.

    Homes meet homes and guests of their group.  Where both have all their rare shingles in their prefixes (alone >= 0), those that
    no other document has (alone) are in neither's overlap, so that two sets of sizes a and b with more than (a + b) / 7 such
    shingles do not link.  Rows lie by that number, and a row's span ends where the sum passes the limit: pages of one template that
    differ in their own words are not compared one by one.  Keys have 48 bits and now and then two are taken for one,
    so the limit is two wider.
    """
    if not len(group):
        return []
    strong, u, wide = alone >= 0, np.clip(alone, 0, (1 << 31) - 1), np.int64(1 << 31)
    top = np.maximum.reduceat(n, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group]
    out = []
    for left, right, same, limited in ((home & strong, home & strong, True, True), (home & ~strong, home & ~strong, True, False), (home & strong, home & ~strong, False, False), (home & strong, ~home & strong, False, True), (home & strong, ~home & ~strong, False, False), (home & ~strong, ~home, False, False)):
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        if not len(left) or not len(right):
            continue
        right = right[np.lexsort((u[right], group[right]))]
        place = group[right] * wide + u[right]
        if same:
            left, start = right, np.arange(1, len(right) + 1)
        else:
            start = np.searchsorted(place, group[left] * wide, "left")
        most = np.clip((n[left] + top[left]) // 7 + 2 - u[left], -1, wide - 1) if limited else wide - 1
        count = np.searchsorted(place, group[left] * wide + most, "right") - start
        out.append((left, right, start, np.maximum(count, 0)))
    return out


def _enumerated(spans: list[tuple[np.ndarray, ...]]):
    """(i, j) of the spans' pairs, PAIRS at a time."""
    for left, right, start, count in spans:
        ends, done = np.cumsum(count), 0
        while done < ends[-1]:
            numbers = np.arange(done, min(int(ends[-1]), done + PAIRS))
            k = np.searchsorted(ends, numbers, "right")
            yield left[k], right[start[k] + numbers - (ends[k] - count[k])]
            done += len(numbers)


def _tile(rows: pa.Table, spanning: bool) -> pa.Table:
    """Pairs of different components in the tiles (token, band) of these rows that the bitmaps let through;
    if ``spanning``, only as many as would join what they could join.

    Rows are of bands of one group, or of the lowest band of the next one, which are guests only; each is a guest in the
    band below its own.
    """
    forest = _Forest()
    band, group = (rows.column(c).to_numpy() for c in ("band", "bands"))
    home, guest = np.flatnonzero(band // BANDS == group), np.flatnonzero((band - 1) // BANDS == group)
    rows = pa.concat_tables([
        rows.take(pa.array(home)).append_column("guest", pa.array(np.zeros(len(home), np.int32))),
        rows.take(pa.array(guest)).set_column(rows.schema.get_field_index("band"), "band", pa.array(band[guest] - 1)).append_column("guest", pa.array(np.ones(len(guest), np.int32))),
    ])
    rows = rows.sort_by([("token", "ascending"), ("band", "ascending"), ("guest", "ascending")])
    token, band, guest, doc, root, n, alone = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "band", "guest", "doc", "root", "n", "alone"))
    sig = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("sig").combine_chunks()]
    lead = rows.column("lead").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, LEAD)
    new = np.r_[True, (token[1:] != token[:-1]) | (band[1:] != band[:-1])]
    spans = _spans(np.cumsum(new) - 1, guest == 0, n, alone)
    widths = np.array([len(s) for s in sig])
    matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(widths):
        own = np.flatnonzero((widths == w) | (widths == 2 * w))
        at = np.full(len(sig), -1)
        at[own] = np.arange(len(own))
        matrices[int(w)] = (np.stack([folded(sig[i], w) for i in own]), at)
    found = [np.zeros((0, 2), np.int64)]
    for i, j in _enumerated(spans):
        keep = (root[i] != root[j]) & (doc[i] != doc[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
        i, j = i[keep], j[keep]
        for w in np.unique(np.minimum(widths[i], widths[j])):
            pick = np.minimum(widths[i], widths[j]) == w
            matrix, at = matrices[int(w)]
            a, b = i[pick], j[pick]
            for c in range(0, len(a), 1 + 400_000 // int(w)):
                x, y = a[c : c + 1 + 400_000 // int(w)], b[c : c + 1 + 400_000 // int(w)]
                ok = enough(_bound(matrix[at[x]], matrix[at[y]], n[x], n[y]), n[x], n[y])
                x, y = x[ok], y[ok]
                if not len(x):
                    continue
                earlier = (lead[x][:, :, None] == lead[y][:, None, :]) & (lead[x] < token[x][:, None])[:, :, None]
                once = ~earlier.any(axis=(1, 2))  # else the pair meets at that shingle too
                x, y = x[once], y[once]
                if spanning:
                    pick_ = np.array([forest.join(r, t) for r, t in zip(root[x].tolist(), root[y].tolist(), strict=True)], bool)
                    x, y = x[pick_], y[pick_]
                found.append(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], axis=1))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found), axis=0)]
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _with_enough(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (token, doc, ...) of the documents that hold as many of them as a link takes."""
    enough_ = rows.groupBy("doc").agg(F.count("*").alias("c")).join(sizes, "doc").where(f"c >= {_LEAST}")
    return rows.join(enough_.select("doc"), "doc", "left_semi")


def _open(held: DataFrame, roots: DataFrame, sizes: DataFrame, store: Scratch, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(token, doc, root of shingles with several components, of documents that such shingles could link to another component; all of those documents' shingles with several)."""
    rows, before = _rooted(held, roots), None
    for k in range(2):
        several = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
        rows = store.put_by(rows.join(several, "token"), "doc", buckets, f"several{k}")
        if before is not None:
            store.drop(before)
        before, rows = rows, _with_enough(rows, sizes)
    # a link takes least_shared() of these: under one order of all, it shows among all but the last so many less one
    by_doc = W.partitionBy("doc")
    placed = rows.join(sizes, "doc").select("token", "doc", "root", "n", F.row_number().over(by_doc.orderBy("token")).alias("no"), F.count("*").over(by_doc).alias("c"))
    open_ = store.put_by(placed.where(f"no <= c - ({_LEAST}) + 1").select("token", "doc", "root"), "doc", buckets, "open", deal=False)
    return open_, before


def _offered(open_: DataFrame, sigs: DataFrame, store: Scratch, spanning: bool) -> DataFrame:
    """Pairs of different components (rows token, doc, root) that share a shingle and could link."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(4 / 3)) + F.lit(1e-9)).cast("int")
    first = F.slice(F.concat(F.sort_array(F.collect_list("token")), F.array_repeat(F.lit((1 << 63) - 1), LEAD)), 1, LEAD)
    leads = open_.groupBy("doc").agg(first.alias("lead"))
    own = F.expr(f"band div {BANDS}")
    below = F.expr(f"(band - 1) div {BANDS}")
    tiles = open_.join(leads.join(sigs, "doc"), "doc").withColumn("band", band + 1)
    buckets = open_.count() // TILE_ROWS + 1
    columns = ["token", "doc", "root", F.col("n").cast("int").alias("n"), "alone", "sig", "lead", "band"]
    tiles = tiles.select(*columns, F.explode(F.array_distinct(F.array(own.cast("int"), below.cast("int")))).alias("bands"))
    tiles = tiles.withColumn("bucket", F.pmod(F.xxhash64("token", "bands"), F.lit(buckets)).cast("int"))
    return store.put(tiles.groupBy("bucket").applyInArrow(lambda rows: trimmed(_tile(rows, spanning)), "a long, b long").distinct(), "tiles")


def _alone(rows: DataFrame, sigs: DataFrame, late: DataFrame) -> DataFrame:
    """sigs with alone: the rare prefix shingles of a document that are not among its rows (token, doc), which hold all that others have; -1 if unknown."""
    met = rows.join(F.broadcast(late), "token", "left_anti").groupBy("doc").agg(F.count("*").alias("met"))
    alone = F.when(F.col("early") >= 0, F.greatest(F.col("early") - F.coalesce("met", F.lit(0)), F.lit(0))).otherwise(-1).cast("int")
    return sigs.join(met, "doc", "left").select("doc", "n", "sig", alone.alias("alone"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.select("token", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", F.coalesce("root", "doc").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", store: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    A document's set: its distinct shingles of five words (A-Z lower-cased), or, with one to four words,
    the whole sequence as one; a null, empty or blank text has none and links with nothing.
    component_id: the smallest doc_id that links reach.  Rows that repeat a doc_id are one
    node with several texts.  A row without doc_id is linked with nothing and has no component_id.
    An empty table gives an empty one.  Whoever gives ``store`` closes it once the result is written.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with store or Scratch(spark, "jaccard") as store:
        n, size = keys.text_bytes(docs)
        frequent = frequent_shingles(docs, n)
        shards = keys.shards_for(size // BYTES_PER_KEY, partitions(spark))
        buckets = min(100_000, max(partitions(spark), shards // 4))
        met = store.put(keys.shared(docs, _emit(frequent), lambda rows: trimmed(_finish(rows)), _MET, shards), "met")
        nodes = store.put_by(met.where("n is not null").select("doc", "n", "rep", "early", "sig"), "doc", buckets, "nodes")
        sigs = nodes.where("sig is not null").select("doc", "n", "sig", "early")
        late = spark.createDataFrame(pa.table({"token": _as_long(np.unique(frequent & keys.KEPT))}))  # ORDER_KEYS at most
        sizes = sigs.groupBy("doc").agg(F.min("n").alias("n"))
        all_held = store.put_by(met.where("token is not null").select("token", "doc"), "doc", buckets, "tokens")
        store.drop(met)
        held = _with_enough(all_held, sizes)
        shared = store.put_by(held.join(held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token"), "doc", buckets, "shared")
        store.drop(all_held)
        held = store.put_by(_with_enough(shared, sizes), "doc", buckets, "held", deal=False)
        store.drop(shared)
        sets = _shingle_sets(held, docs, store, buckets)

        few = held.withColumn("no", F.row_number().over(W.partitionBy("doc").orderBy("token"))).where(F.col("no") <= FEW).drop("no")
        few = store.put_by(few, "doc", buckets, "few", deal=False)
        central = few.groupBy("doc").agg(F.avg("df").alias("central"))
        best = few.join(central, "doc").groupBy("token").agg(F.max(F.struct("central", F.col("doc").alias("lead"))).alias("best"))
        votes = few.join(best.select("token", F.col("best.lead").alias("lead")), "token").where("doc <> lead").groupBy("doc", "lead").count()
        stars = votes.withColumn("no", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("count"), "lead"))).where(f"no <= {LEADERS}")
        stars = store.put(stars.select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b")).distinct(), "stars")
        near = store.put(_within_bound(stars, sigs), "near")
        same = nodes.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
        found = [_verify(near, sets, store)]
        store.drop(stars, near)
        roots = components(found[0].unionByName(same), store)
        tiles = _offered(_rooted(few, roots), _alone(held, sigs, late), store, True)
        found.append(_verify(tiles, sets, store))
        store.drop(tiles, few, roots)
        roots = components(found[0].unionByName(found[1]).unionByName(same), store)
        open_, several = _open(held, roots, sizes, store, buckets)
        store.drop(held, roots)
        tiles = _offered(open_, _alone(several, sigs, late), store, False)
        store.drop(open_, several)
        found.append(_verify(tiles, sets, store))
        store.drop(tiles, sets)
        roots = components(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(same), store)
        store.drop(*found)
        out = nodes.join(roots.withColumnRenamed("node", "doc"), "doc", "left")
        return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
      FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d WHERE doc_id IN (SELECT a FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS root FROM r GROUP BY 1) m USING (doc_id)
"""
