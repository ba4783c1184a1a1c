"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; every row is put in
the list of its nearest centroid with the code of its residual.  A query visits the lists nearest to
it and ranks their rows by distance tables on the codes (asymmetric: the query itself is not quantised); the best of all
its lists are ranked again by the exact distance of the original vectors.

How many lists a query visits and how many rows are ranked again is measured: the least of each by which queries of
the sample find the share RECALL of their nearest rows of the sample.  Vectors in clusters need a few lists; vectors
that lie alike in all directions need many, as no list holds a query's neighbours together.

Lists lie together in lanes of about LANE_ROWS rows, and a longer list is cut into several; a lane is one task's work, and
a query goes once to each lane that has a list for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table
from .vectors import dimension, matrix, usable

#: Rows that centroids and codebooks are fitted on, at most.
SAMPLE = 32_768
#: Lists: about the root of the number of rows, as long as the sample has so many rows for each centroid; from there on lists grow longer.
ROWS_PER_LIST = 4
#: Bytes of a code, and values of a byte.
PARTS, VALUES = 16, 256
#: Share of the nearest rows to be found, in the sample, and of whose queries it is measured.
RECALL, TRIALS = 0.96, 256
#: Shares of the lists, and numbers of rows to be ranked again, that are tried, rising.
PROBES, RERANKS = (0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0), (32, 64, 128, 256, 512)
LANE_ROWS = 16_384


@dataclass
class Index:
    rows: DataFrame  # list, lane, vec_id, code, vector
    centroids: np.ndarray
    codebooks: np.ndarray  # PARTS x VALUES x width
    d: int
    probe: float  # share of the lists, and rows ranked again, that reach RECALL
    rerank: int
    lanes: dict[int, list[int]]  # of each list
    held: np.ndarray  # distinct vec_ids of each list


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, squares = np.empty(len(x), np.int64), (centres**2).sum(1)
    for a in range(0, len(x), 4_096):
        out[a : a + 4_096] = np.argmin(squares - 2 * x[a : a + 4_096] @ centres.T, axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of a fixed start; a centre that loses all its rows stays where it was."""
    centres = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _parts(x: np.ndarray) -> np.ndarray:
    """rows x PARTS x width, padded with zeros."""
    width = -(-x.shape[1] // PARTS)
    return np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1]))).reshape(len(x), PARTS, width)


def _codes(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    parts = _parts(x - centroids[own])
    return np.stack([_nearest(parts[:, p], codebooks[p]) for p in range(PARTS)], axis=1).astype(np.uint8)


def _about(q: np.ndarray, centre: np.ndarray, codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """Squared distances of queries to the rows of one list, by their codes."""
    tables = ((_parts(q - centre)[:, :, None, :] - codebooks[None]) ** 2).sum(-1)
    out = np.zeros((len(q), len(codes)))
    for p in range(PARTS):
        out += tables[:, p][:, codes[:, p]]
    return out


def _visited(q: np.ndarray, centroids: np.ndarray, probe: float, held: np.ndarray, k: int) -> np.ndarray:
    """Which lists each query visits: the nearest, or all unless one of these alone holds more than k vec_ids
    (a list may hold the query itself, and lists may share a vec_id)."""
    visits = max(1, round(probe * len(centroids)))
    far = (centroids**2).sum(1) - 2 * q @ centroids.T
    out = np.zeros(far.shape, bool)
    np.put_along_axis(out, np.argpartition(far, visits - 1, axis=1)[:, :visits], True, axis=1)
    out[np.where(out, held, 0).max(axis=1, initial=0) <= k] = True
    return out


def tuned(sample: np.ndarray, centroids: np.ndarray, codebooks: np.ndarray, k: int = 10) -> tuple[float, int]:
    """(probe, rerank): the least with which queries of the sample find RECALL of their k nearest in it."""
    at = np.unique(np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int))
    own = _nearest(sample, centroids)
    codes = _codes(sample, own, centroids, codebooks)
    # a distance by the tables is that to the row which the code stands for
    meant = centroids[own] + np.concatenate([codebooks[p][codes[:, p]] for p in range(PARTS)], axis=1)[:, : sample.shape[1]]
    found = np.zeros((len(PROBES), len(RERANKS)))
    for i in at.tolist():
        q = sample[i]
        exact = ((sample - q) ** 2).sum(1)
        exact[i] = np.inf
        want = np.argsort(exact, kind="stable")[: min(k, len(sample) - 1)]
        order = np.argsort(((centroids - q) ** 2).sum(1), kind="stable")
        about = ((meant - q) ** 2).sum(1)
        about[i] = np.inf
        place = np.empty(len(centroids), int)
        place[order] = np.arange(len(order))
        ranked, visit = np.argsort(about, kind="stable"), place[own]
        for a, share in enumerate(PROBES):
            seen = ranked[visit[ranked] < max(1, round(share * len(centroids)))]
            for b, rerank in enumerate(RERANKS):
                found[a, b] += np.isin(want, seen[:rerank]).mean() if len(want) else 1.0
    found /= len(at)
    for a, share in enumerate(PROBES):
        for b, rerank in enumerate(RERANKS):
            if found[a, b] >= RECALL:
                return share, rerank
    return 1.0, RERANKS[-1]


def build(vectors: DataFrame, column: str = "embedding", store: Scratch | None = None) -> Index | None:
    """An index of every usable row, or None if there is none.

    Rows whose vector is null, all zeros, of another length than most, or holds null or non-finite
    components, and rows without vec_id, take no part.
    """
    store = store or Scratch(vectors.sparkSession, "ann")
    d = dimension(vectors, column)
    good = store.put(usable(vectors, column, d, zero=False), "vectors")
    n = good.count() if d else 0
    if not n:
        return None
    picked = good if n <= SAMPLE else good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * SAMPLE / n))
    sample = np.array(picked.select("vector").limit(SAMPLE).toPandas()["vector"].tolist(), np.float64).reshape(-1, d)
    centroids = k_means(sample, max(1, min(-(-len(sample) // ROWS_PER_LIST), int(n**0.5))))
    residuals = _parts(sample - centroids[_nearest(sample, centroids)])
    codebooks = np.zeros((PARTS, VALUES, residuals.shape[2]))
    for p in range(PARTS):
        fitted = k_means(residuals[:, p], min(VALUES, len(sample)))
        codebooks[p, : len(fitted)] = fitted
        codebooks[p, len(fitted) :] = fitted[0]

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), d)
            own = _nearest(x, centroids)
            codes = _codes(x, own, centroids, codebooks)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vector")], names=["list", "vec_id", "code", "vector"])

    rows = store.put(good.mapInArrow(assign, "list int, vec_id long, code binary, vector array<double>"), "lists")
    lanes, held, filled = {}, np.zeros(len(centroids), np.int64), 0
    for row in rows.groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")).orderBy("list").collect():  # a row a list
        held[row.list] = row.ids
        first, filled = filled // LANE_ROWS, filled + row.n
        lanes[row.list] = list(range(first, max(first, (filled - 1) // LANE_ROWS) + 1))
    table_ = vectors.sparkSession.createDataFrame([(k, v) for k, v in lanes.items()], "list int, lanes array<int>")
    rows = rows.join(F.broadcast(table_), "list")
    lane = F.get("lanes", F.pmod(F.xxhash64("vec_id"), F.size("lanes")).cast("int"))
    index = store.put(rows.select("list", lane.alias("lane"), "vec_id", "code", "vector"), "index")
    store.drop(good)
    return Index(index, centroids, codebooks, d, *tuned(sample, centroids, codebooks), lanes, held)


def search(index: Index, queries: DataFrame, k: int = 10, probe: float | None = None, rerank: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest found of each query (vec_id, vector).

    Rows with the query's own vec_id are no candidates.  Ties go to the smaller vec_id.  A vec_id met
    several times counts once, at its nearest.  A query visits all lists unless one of its nearest alone
    holds more than k vec_ids, so none gets fewer than k while there are more.  ``probe`` and ``rerank`` are the
    index's own if not given.
    """
    centroids, codebooks, d, lanes, held = index.centroids, index.codebooks, index.d, index.lanes, index.held
    probe, rerank = probe or index.probe, max(k, rerank or index.rerank)
    lists_of = np.zeros((1 + max(x for own in lanes.values() for x in own), len(centroids)), bool)
    for j, own in lanes.items():
        lists_of[own, j] = True
    by_lane = np.ascontiguousarray(lists_of.T.astype(np.float32))

    def route(batches):
        for batch in batches:
            wanted = _visited(matrix(batch.column("vector"), d), centroids, probe, held, k).astype(np.float32) @ by_lane > 0
            at, lane = np.nonzero(wanted)
            yield batch.take(pa.array(at)).append_column("its_lane", pa.array(lane.astype(np.int32)))

    routed = queries.select("vec_id", "vector").mapInArrow(route, "vec_id long, vector array<double>, its_lane int")

    def within(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asked):
            ids, own = rows.column("vec_id").to_numpy(), rows.column("list").to_numpy()
            order = np.argsort(own, kind="stable")
            ids, own = ids[order], own[order]
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)[order]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            # a vec_id may recur: its rows are one candidate, at the nearest of them, before anything is cut
            by_id = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])
            names = ids[by_id][first]
            q_ids, q = asked.column("vec_id").to_numpy(), matrix(asked.column("vector"), d)
            for a in range(0, len(q), 64):
                part = q[a : a + 64]
                visits, about = _visited(part, centroids, probe, held, k), np.full((len(part), len(ids)), np.inf)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    some = np.flatnonzero(visits[:, own[x]])
                    if len(some):
                        about[some, x:y] = _about(part[some], centroids[own[x]], codes[x:y], codebooks)
                about = about[:, by_id]
                if len(names) < len(ids):
                    about = np.minimum.reduceat(about, first, axis=1)
                about[names[None, :] == q_ids[a : a + 64, None]] = np.inf
                best = np.argpartition(about, rerank - 1, axis=1)[:, :rerank] if about.shape[1] > rerank else np.broadcast_to(np.arange(about.shape[1]), about.shape)
                far = np.take_along_axis(about, best, axis=1)
                i, j = np.nonzero(np.isfinite(far))
                out.append((q_ids[a + i], names[best[i, j]], far[i, j]))
        query, vec, far = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(far, pa.float64())], names=["query_id", "vec_id", "about"])

    codes_only = index.rows.select("list", "lane", "vec_id", "code")
    found = codes_only.groupBy("lane").cogroup(routed.groupBy("its_lane")).applyInArrow(within, "query_id long, vec_id long, about double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("about").alias("about"))
    best = found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("about", "vec_id"))).where(F.col("place") <= rerank)
    pairs = best.select("query_id", "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    pairs = pairs.join(index.rows.select("vec_id", "vector"), "vec_id")

    def exactly(batches):
        for batch in batches:
            gap = matrix(batch.column("vector"), d) - matrix(batch.column("q"), d)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(np.sqrt((gap**2).sum(1)))], names=["query_id", "vec_id", "score"])

    once = pairs.select("query_id", "vec_id", "q", "vector").mapInArrow(exactly, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.rows.where("vec_id % 100 = 0"))
