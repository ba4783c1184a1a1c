"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that waste the
least padding; inside a bucket every document is padded to the boundary, and batches take as many
documents as the token budget allows.

Lengths of 512 and more are counted by steps of at most 1/256 (rounded up), so the histogram has at most
512 + 256 rows for each doubling, whatever the corpus is.  Each boundary is then lowered to the longest document of its
bucket, so a bucket is never longer than what is in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table, word_count

BUCKETS = 16
#: Padded tokens of a batch; a longer document is a batch of its own.
BUDGET = 32_768
#: Rows numbered together, about.
PART_ROWS = 16_384


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Rising lengths (a subset of the given, rising ones, with the last) that minimise the padding."""
    m, k = len(lengths), min(buckets, len(lengths))
    if not m:
        return []
    upto = np.r_[0, np.cumsum(counts)].astype(np.float64)
    b = lengths.astype(np.float64)
    best = b * upto[1:]  # the first j + 1 lengths in one bucket
    came = np.zeros((k, m), np.int64)
    for t in range(1, k):
        nxt = best.copy()
        came[t] = -1
        for j in range(t, m):
            costs = best[:j] + b[j] * (upto[j + 1] - upto[1 : j + 1])
            i = int(np.argmin(costs))
            if costs[i] < nxt[j]:
                nxt[j], came[t, j] = costs[i], i
        best = nxt
    out, j = [], m - 1
    for t in range(k - 1, -1, -1):
        if t == 0:
            out.append(int(lengths[j]))
            break
        if came[t, j] >= 0:
            out.append(int(lengths[j]))
            j = int(came[t, j])
    return out[::-1]


def _on_grid(n):
    """The least grid length that is not below n."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) + F.lit(1e-12)).cast("int") - 8)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (F.floor((n + step - 1) / step) * step).cast("long")


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, text: str = "text", store: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, length (the bucket's boundary), batch (in the bucket), place (in the batch).

    A token is a word.  Null, empty and blank texts have none; they take one padded token in a batch.  Rows that repeat a
    doc_id are rows of their own.  The order in a bucket is pseudo-random and the same in every run over the same
    files.  A batch's documents times its bucket's length is at most the budget unless it is one document.
    An empty table gives an empty one.
    """
    store = store or Scratch(docs.sparkSession, "pack")
    rows = store.put(docs.select("doc_id", word_count(f"`{text}`").alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    histogram = rows.groupBy(_on_grid(F.col("n_tokens")).alias("length")).count().orderBy("length").toPandas()
    cuts = boundaries(histogram["length"].to_numpy(), histogram["count"].to_numpy(), buckets)
    longest = dict(zip(cuts, cuts, strict=True))
    if cuts and cuts[-1] >= 512:
        least = F.array_min(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c >= F.col("n_tokens")))
        longest |= {r.cut: r.most for r in rows.groupBy(least.alias("cut")).agg(F.max("n_tokens").alias("most")).collect()}  # a row a bucket
    cuts = [int(longest[c]) for c in cuts]
    parts = int(histogram["count"].sum()) // PART_ROWS + 1
    ladder = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    above = F.filter(ladder, lambda c: c >= F.col("n_tokens"))
    placed = rows.withColumn("length", F.get(above, 0)).withColumn("bucket", F.lit(len(cuts)) - F.size(above))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    sums = placed.groupBy("bucket", "part").count()
    ahead = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("bucket", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = W.partitionBy("bucket", "part").orderBy(F.xxhash64(F.lit("pack"), "row"), "row")
    slot = F.col("before") + F.row_number().over(inside) - 1
    per_batch = F.greatest(F.lit(1), F.expr(f"{budget} div greatest(1, length)"))
    return (
        placed.join(sums, ["bucket", "part"])
        .withColumn("slot", slot)
        .withColumn("per_batch", per_batch)
        .select("doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "length", F.expr("slot div per_batch").alias("batch"), F.expr("CAST(slot % per_batch AS INT)").alias("place"))
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
