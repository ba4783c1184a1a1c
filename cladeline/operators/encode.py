"""Observations: decoding, joining sequences to leaves, patterns with weights, column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import kept
from ..sources.text import MASK_CODES, UNKNOWN


def decode(code: Column) -> Column:
    """Mask of a nucleotide code, in either case; null for no code."""
    c = F.upper(code)
    at = F.call_function("instr", F.lit(MASK_CODES[1:]), c)
    return F.when(c == "U", F.lit(8)).when(F.call_function("instr", F.lit(UNKNOWN), c) > 0, F.lit(15)).when((F.length(c) == 1) & (at > 0), at).cast("int")


def decoded(code: Column) -> Column:
    """decode(), failing on what is no code."""
    mask = decode(code)
    return F.when(mask.isNull(), F.raise_error(F.concat(F.lit("no nucleotide code: "), F.coalesce(code, F.lit("null")))).cast("int")).otherwise(mask)


def allows(mask: Column, state: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << state)) != 0


def mismatches(leaves: DataFrame, sequences: DataFrame) -> DataFrame:
    """name, side for every leaf without sequence, sequence without leaf, and name that occurs twice on a side."""
    left, right = leaves.select(F.col("label").alias("name")), sequences.select("name")
    twice = lambda x, side: x.groupBy("name").count().where("count > 1").select("name", F.lit(side).alias("side"))
    return (
        left.join(right, "name", "left_anti").select("name", F.lit("leaf without sequence").alias("side"))
        .unionByName(right.join(left, "name", "left_anti").select("name", F.lit("sequence without leaf").alias("side")))
        .unionByName(twice(left, "leaf twice"))
        .unionByName(twice(right, "sequence twice"))
    )


def taxon_faults(left: DataFrame, right: DataFrame, samples: int = 5) -> DataFrame:
    """side, n, sample: how many names (column ``name``) one side has and the other lacks, and the first few of them."""
    only = lambda a, b, side: a.select("name").distinct().join(b, "name", "left_anti").withColumn("side", F.lit(side))
    rows = only(left, right, "left only").unionByName(only(right, left, "right only"))
    few = rows.withColumn("place", F.row_number().over(W.partitionBy("side").orderBy("name")))
    return few.groupBy("side").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.col("name")))), ", ").alias("sample"))


def encode(leaves: DataFrame, sequences: DataFrame) -> DataFrame:
    """leaves (node_id, label) and sequences (name, sequence), one to one -> site, node_id, mask.

    Sides are paired as groups of a name; a name that is not once on each side fails the job.
    """
    sides = leaves.select(F.col("label").alias("name"), "node_id", F.lit(None).cast("string").alias("sequence"))
    sides = sides.unionByName(sequences.select("name", F.lit(None).cast(leaves.schema["node_id"].dataType).alias("node_id"), "sequence"))
    one = sides.groupBy("name").agg(F.count("node_id").alias("n_leaves"), F.count("sequence").alias("n_sequences"), F.max("node_id").alias("node_id"), F.max("sequence").alias("sequence"))
    fault = F.concat(F.lit("not one leaf and one sequence: "), F.coalesce("name", F.lit("null")))
    rows = one.where(F.when((F.col("n_leaves") == 1) & (F.col("n_sequences") == 1), True).otherwise(F.raise_error(fault).cast("boolean")))
    letters = F.split("sequence", "")
    return rows.select("node_id", F.posexplode(letters).alias("site", "code")).where("code <> ''").select("site", "node_id", decoded(F.col("code")).alias("mask"))


def select_sites(sites: DataFrame, first: int, count: int, n_sites: int | None = None) -> DataFrame:
    """Sites first .. first + count - 1; an empty range, or one beyond ``n_sites``, is an error."""
    if count < 1 or first < 0 or (n_sites is not None and first + count > n_sites):
        raise ValueError(f"no such sites: {first} and {count} from there")
    return sites.where(F.col("site").between(first, first + count - 1))


def to_sites(observations: DataFrame) -> DataFrame:
    """site, node_id, mask -> site, nodes, masks: one row a site, nodes rising."""
    pairs = F.array_sort(F.collect_list(F.struct("node_id", "mask")))
    return observations.groupBy("site").agg(pairs.alias("o")).select("site", F.col("o.node_id").alias("nodes"), F.col("o.mask").alias("masks"))


def compress(sites: DataFrame, by: list[str]) -> DataFrame:
    """Distinct columns with their weights, numbered by first occurrence."""
    rows = sites.groupBy(*by).agg(F.sum(F.col("weight") if "weight" in sites.columns else F.lit(1)).cast("long").alias("weight"), F.min("site").alias("first_site"))
    return rows


def numbered(patterns: DataFrame) -> DataFrame:
    """Adds pattern, the rank of the first occurrence."""
    return ranked(patterns, ["first_site"], "pattern")


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's place in a total order, from 0, without a window in one task.

    Rows are dealt by range and sorted once, and written; a row's place is its number in its file and the rows of the files before.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = kept(spark, "ranked").put(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "ranked")
    placed = held.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    ahead = F.sum("n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1))  # a row a file, of which there are ``parts``
    starts = placed.groupBy("_file").agg(F.count("*").alias("n")).select("_file", F.coalesce(ahead, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_file").withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_file", "_row", "_start")


def column_coverage(observations: DataFrame) -> DataFrame:
    """site -> covered (cells with one state), union of states and whether they vary."""
    one = F.bit_count("mask") == 1
    rows = observations.groupBy("site").agg(F.count_if(one).alias("covered"), F.bit_or(F.when(one, F.col("mask")).otherwise(F.lit(0))).alias("states"))
    return rows.withColumn("variable", F.bit_count("states") > 1)
