"""Lines of text by splits, and what is carried from line to line, without a task that holds a whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a range of carry_forward(), about: order numbers that lie so far apart are of different ranges.
RANGE = 65_536


def numbered_lines(spark, path: str | list[str], log: Column | None = None) -> DataFrame:
    """file, line_no, line of text logs, read by splits, so that no task needs a whole log.

    A row's number in its split is its distance from the split's first row; how many lines lie before a split is summed over the splits
    of the log.  ``log`` names a row's log by its path (``file``); files of one log follow each other in the order of their paths.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.option("lineSep", "\n").text(path).select(*where, F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    splits = splits.withColumn("log", F.col("file") if log is None else log)
    above = F.sum("lines").over(W.partitionBy("log").orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("file", "start", "log", (F.coalesce(above, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["file", "start"]).select(F.col("log").alias("file"), (F.col("id") + F.col("shift")).alias("line_no"), F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))


def carry_forward(rows: DataFrame, by: list[str], order: str, value: Column, name: str, width: int = RANGE) -> DataFrame:
    """Adds the last value that is not null at or above the row, in the order of a whole number.

    In two levels: the last value of each range of ``width`` numbers is carried over the ranges, and each range then begins with what was
    carried to it.  So a task holds one range, however long the file is.
    """
    held = rows.withColumn("_value", value).withColumn("_range", F.expr(f"`{order}` div {width}"))
    last = held.groupBy(*by, "_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    before = F.last("_last", True).over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    keys = [*by, "_range"]
    ranges = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], before.alias("_before"))
    same = None
    for i, c in enumerate(keys):
        equal = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        same = equal if same is None else same & equal
    inside = F.last("_value", True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return held.join(ranges, same).withColumn(name, F.coalesce(inside, "_before")).drop("_value", "_range", "_before", *[f"_k{i}" for i in range(len(keys))])
