"""Pruning as relational algebra: one join and one two-phase sum for each level of a shallow tree.

Partial likelihoods are rows (site, node, state, log value).  Everything stays in the JVM; it serves as a
second route to the kernels' results.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import SpectralForm
from ..streaming.streams import folder


def _log(x):
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def transition_rows(nodes: DataFrame, form: SpectralForm) -> DataFrame:
    """node_id, a (parent state), b (child state), p."""
    p = lambda a, b: sum((F.lit(float(form.coef[k, a, b])) * F.exp(F.lit(float(form.lam[k])) * F.col("branch_length")) for k in range(4)), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), p(a, b).alias("p")) for a in range(4) for b in range(4)])
    return nodes.where("parent_id IS NOT NULL").select("node_id", "parent_id", F.explode(cells).alias("c")).select("node_id", "parent_id", "c.a", "c.b", "c.p")


def depths(nodes: DataFrame) -> DataFrame:
    """node_id, depth of every node, written once: each level is one join of the recursion, and is not worked out again."""
    spark, view, path = nodes.sparkSession, f"nodes_{uuid.uuid4().hex}", folder(nodes.sparkSession, "depths")
    nodes.createOrReplaceTempView(view)
    try:
        walk = spark.sql(f"""WITH RECURSIVE walk(node_id, depth) MAX RECURSION LEVEL 1000000 AS (
          SELECT node_id, 0 FROM {view} WHERE parent_id IS NULL
          UNION ALL SELECT n.node_id, w.depth + 1 FROM walk w JOIN {view} n ON n.parent_id = w.node_id)
          SELECT node_id, depth FROM walk""")
        walk.write.parquet(path)
    finally:
        spark.catalog.dropTempView(view)
    return spark.read.parquet(path)


def log_likelihoods(nodes: DataFrame, observations: DataFrame, form: SpectralForm, root_pi: np.ndarray) -> DataFrame:
    """site, log_likelihood.  Nodes without an observation are unknown; the root has none."""
    deep = depths(nodes)
    deepest = deep.agg(F.max("depth")).first()[0] or 0
    levels = [deep.where(F.col("depth") == k).select("node_id") for k in range(1, deepest + 1)]
    p = transition_rows(nodes, form)
    seen = observations.select("site", "node_id", F.explode(F.array(*[F.struct(F.lit(s).alias("b"), F.when(F.col("mask").bitwiseAND(F.lit(1 << s)) != 0, 0.0).otherwise(float("-inf")).alias("l")) for s in range(4)])).alias("s")).select("site", "node_id", "s.b", "s.l")
    partial = None
    for level in reversed(levels):
        own = seen.join(level, "node_id", "left_semi")
        if partial is not None:
            own = own.unionByName(partial.join(level, "node_id", "left_semi"))
        # the node's own observation and the sum of its children's messages multiply
        own = own.groupBy("site", "node_id", "b").agg(F.sum("l").alias("l"))
        joined = own.join(p, ["node_id", "b"])
        top = joined.groupBy("site", "parent_id", "node_id", "a").agg(F.max("l").alias("m"), F.collect_list(F.struct("p", "l")).alias("t"))
        message = _log(F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["p"] * F.exp(x["l"] - F.col("m")))) + F.col("m")
        message = F.when(F.col("m") == float("-inf"), F.lit(float("-inf"))).otherwise(message)
        partial = top.select("site", F.col("parent_id").alias("node_id"), F.col("a").alias("b"), message.alias("l")).groupBy("site", "node_id", "b").agg(F.sum("l").alias("l"))
    pi = F.element_at(F.array(*[F.lit(float(x)) for x in root_pi]), F.col("b") + 1)
    tops = partial.groupBy("site").agg(F.max("l").alias("m"), F.collect_list(F.struct(pi.alias("pi"), "l")).alias("t"))
    total = _log(F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["pi"] * F.exp(x["l"] - F.col("m")))) + F.col("m")
    return tops.select("site", F.when(F.col("m") == float("-inf"), F.lit(float("-inf"))).otherwise(total).alias("log_likelihood"))
