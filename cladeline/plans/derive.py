"""Trees and observations made from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trees import Tree
from ..operators.encode import to_sites
from ..operators.infer import collect_tree
from ..sources.store import kept  # noqa: F401  stores of queries

SITES = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, parent_id, branch_length: root 0, regions, nations, suppliers."""
    root = spark.range(1).select(F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0.0).alias("branch_length"))
    regions = read(spark, sf_dir, "region").select((1 + F.col("r_regionkey")).cast("long"), F.lit(0).cast("long"), 0.05 + 0.01 * F.col("r_regionkey"))
    nations = read(spark, sf_dir, "nation").select((6 + F.col("n_nationkey")).cast("long"), (1 + F.col("n_regionkey")).cast("long"), 0.02 + 0.01 * (F.col("n_nationkey") % 7))
    suppliers = read(spark, sf_dir, "supplier").select((31 + F.col("s_suppkey")).cast("long"), (6 + F.col("s_nationkey")).cast("long"), 0.01 + 0.0001 * (F.col("s_suppkey") % 1000))
    return root.union(regions).union(nations).union(suppliers)


def tree(spark: SparkSession, sf_dir: str):
    return collect_tree(tree_nodes(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, node_id, mask: the wide recipe, one cell for each supplier seen at a site."""
    bit = F.call_function("shiftleft", F.lit(1), (F.col("l_partkey") % 4).cast("int"))
    cells = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SITES).alias("site"), (31 + F.col("l_suppkey")).alias("node_id"))
    return cells.agg(F.bit_or(bit).alias("mask"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_sites(observations(spark, sf_dir))


def star() -> tuple[Tree, list[int]]:
    """Four tips, 1 to 4, under node 0."""
    return Tree([-1, 0, 0, 0, 0], [0.0, 0.1, 0.2, 0.3, 0.4]), [0, 1, 2, 3, 4]


def narrow_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, m1..m4: the narrow recipe, one site for each order, 15 where there is no such line."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    bit = F.call_function("shiftleft", F.lit(1), (F.col("l_partkey") % 4).cast("int"))
    cell = lambda k: F.bit_or(F.when(F.col("l_linenumber") == k, bit)).alias(f"c{k}")
    seen = lines.groupBy(F.col("l_orderkey").alias("site")).agg(*[cell(k) for k in range(1, 5)])
    every = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site")).distinct()
    return every.join(seen, "site", "left").select("site", *[F.coalesce(f"c{k}", F.lit(15)).alias(f"m{k}") for k in range(1, 5)])
