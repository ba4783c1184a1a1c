"""Exact top-k search by term-at-a-time accumulation.

Components are terms and floor(scale * x) their weights.  Queries come in chunks and candidates in
lanes; for a chunk and a lane, each term's postings, weighted by the queries that hold it, are
scattered into dense arrays of scores, a partition selects the best of each array, and the winners of all
lanes are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, partitions, table
from .vectors import dimension, matrix, usable

SCALE = 1024
#: Queries of a chunk and rows of a lane, about, which meet in one task; the longer both, the less is sent twice.
CHUNK, LANE_ROWS = 4_096, 32_768
#: Rows of a lane where there are fewer lanes than tasks; queries and candidates scored at once.
LEAST_ROWS, PART, STRIP = 2_048, 256, 2_048


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, term by term; a query takes part only in terms for which it has a weight."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        postings = np.flatnonzero(candidates[:, term])
        holders = np.flatnonzero(queries[:, term])
        if not len(postings) or not len(holders):
            continue
        weights = queries[holders, term][:, None] * candidates[postings, term][None, :]
        if len(postings) == len(candidates) and len(holders) == len(queries):
            scores += weights
        else:
            scores[np.ix_(holders, postings)] += weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > cut)
        level = np.flatnonzero(scores == cut)
        if len(level) > k - len(above):
            level = level[np.argpartition(ids[level], k - len(above) - 1)[: k - len(above)]] if k > len(above) else level[:0]
        places = np.concatenate([above, level])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Both sides have vec_id and the vector column; weights are floor(scale * x) in double.  Rows with the query's
    own vec_id are no candidates.  Ties go to the smaller vec_id; a vec_id met several times counts once,
    at its best.  Rows without vec_id, and vectors that are null, of another length than most or hold
    null or non-finite components, take no part.  With fewer candidates than k all are returned.
    """
    spark = vectors.sparkSession
    store = Scratch(spark, "topk")
    d = dimension(vectors, column)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def weighted(frame: DataFrame) -> DataFrame:
        x = F.transform("vector", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
        return usable(frame, column, d, zero=True).select("vec_id", x.alias("w"), F.monotonically_increasing_id().alias("row"))

    candidates = store.put(weighted(vectors), "candidates")
    asked = store.put(weighted(queries), "queries")
    n = candidates.count()
    lanes, chunks = max(n // LANE_ROWS + 1, min(partitions(spark), n // LEAST_ROWS + 1)), asked.count() // CHUNK + 1
    left = candidates.select("vec_id", "w", F.pmod(F.xxhash64("row"), F.lit(lanes)).alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = asked.select("vec_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("q_lane"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("q_chunk"))

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asked):
            ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("w"), d, np.int64)
            q_ids, q = asked.column("vec_id").to_numpy(), matrix(asked.column("w"), d, np.int64)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for c in range(0, len(q), PART):
                part, part_ids = q[c : c + PART], q_ids[c : c + PART]
                held: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(part)
                for a in range(0, len(ids), STRIP):
                    strip = ids[a : a + STRIP]
                    scores = accumulate(part, x[a : a + STRIP])
                    # a vec_id may recur: it is one candidate, at its best, before anything is cut to k
                    first = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]])
                    if len(first) < len(strip):
                        strip, scores = strip[first], np.maximum.reduceat(scores, first, axis=1)
                    for b in range(len(part)):
                        other = np.flatnonzero(strip != part_ids[b]) if (strip == part_ids[b]).any() else slice(None)
                        own, names = scores[b][other], strip[other]
                        places = best(own, names, k)
                        s, v = np.r_[held[b][0], own[places]], np.r_[held[b][1], names[places]]
                        # and one that goes on from strip to strip, too
                        order = np.lexsort((v, -s))
                        order = order[np.sort(np.unique(v[order], return_index=True)[1])][:k]
                        held[b] = s[order], v[order]
                for b, (s, v) in enumerate(held):
                    out.append((np.full(len(s), part_ids[b]), v, s))
        query, vec, value = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in (query, vec, value)], names=["query_id", "vec_id", "score"])

    found = left.groupBy("lane", "chunk").cogroup(right.groupBy("q_lane", "q_chunk")).applyInArrow(score, "query_id long, vec_id long, score long")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP9_SQL = r"""
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT)) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
