"""Connected components by alternating large-star and small-star steps, cut by tables in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, store: Scratch) -> DataFrame:
    """links (a, b) -> (node, root), a table of the store: the smallest id that links reach, for every node of a link.

    A round hangs every neighbour of a node under the least of them.  It is over when each node hangs
    under one other and that one under none.
    """
    edges = store.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = store.put(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = store.put(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct(), "small")
        store.drop(edges, large)
        edges = small
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = store.put(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")
    store.drop(edges)
    return found


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
