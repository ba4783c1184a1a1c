"""Mixing sources to target weights by a low-discrepancy schedule.  DataFrame functions only.

Each source's documents are put in a pseudo-random order and laid end to end as one stream of words,
cut into blocks of BLOCK words.  The schedule's slot j holds the fractional part of j divided by the
golden ratio (in steps of 2 ** -31); the sources' cumulative target shares cut [0, 1) into intervals, and the slot goes to the source
whose interval holds its point.  A source's k-th slot takes the k-th block of its stream, which starts
again from the front after the end (up to ``max_repeats`` passes), so every prefix of the schedule is
mixed close to the targets.  What a source's slots hold beyond its target is cut off; blocks for which
the schedule, which deviates by some slots, has none left are appended to it, so every quota is met.

Prefix sums over a source are taken in two levels (hash buckets, then rows of a bucket), so that a
source that holds most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import located
from .common import Scratch, partitions, table, word_count

#: Words of a block.
BLOCK = 64
#: 2 ** 31 divided by the golden ratio, and odd: slots run through all 2 ** 31 points before one recurs.
GOLDEN, TURN = 1_327_217_885, 2**31
#: Slots of the schedule beyond the whole of the targets, so that few sources need slots appended; the quotas cut them off.
SPARE = 256
#: The unit interval's cells by which points meet the sources' intervals.
CELLS = 4096
#: Rows of a bucket of a source's stream, about.
BUCKET_ROWS = 1024
#: Rows of a block by which rows are named.
BLOCK_ROWS = 4096
#: Weights by source in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3, share: float = 1.0) -> DataFrame:
    """source, source_size -> with weight and target; one row a source (null is a source, and last).

    The targets share ``share`` of all sizes by weight; none is above ``max_repeats`` times its source,
    the excess going to the others by weight.  That is the water level L with
    sum(min(weight * L, cap)) = total: sources in order of cap / weight are full up to the first whose
    ratio is above the level that the rest would get.
    """
    everything = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("order_no", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("order_no", F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "order_no")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    levels = capped.select(
        "*",
        (F.sum("source_size").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        (F.sum("weight").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    ).withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    ratio = F.col("cap") / F.col("weight")
    free = F.when(ratio > F.col("level"), F.struct(ratio.alias("ratio"), "order_no", "level"))
    first = F.min(free).over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.withColumn("water", first["level"]).select(
        "source", "source_size", "order_no", "weight",
        F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("water")), F.col("cap")).alias("target"),
    )


def streams(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size, bucket and a pseudo-random place in the bucket; see with_positions()."""
    return docs.withColumn("size", word_count(text)).withColumn("place", F.xxhash64(F.lit("mix"), "doc_id", text))


def with_positions(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (source, size, place) -> with start: words of the source's stream before the row."""
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("place", 32), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s_source"),
        F.col("bucket").alias("s_bucket"),
        F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"),
    )
    inside = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
        .withColumn("start", (F.col("bucket_start") + F.col("inside")).cast("long"))
        .drop("s_source", "s_bucket", "bucket_start", "inside", "bucket")
    )


def schedule(targets: DataFrame, total: Column | int, block: int = BLOCK) -> DataFrame:
    """slot, source (its order_no), rank: the slot is its source's rank-th, from 0.

    Points meet the intervals of the sources through CELLS cells: each interval is listed under the
    cells it touches (at most CELLS plus two a source), so a slot finds its source by an equi join.
    """
    spark = targets.sparkSession
    order = W.partitionBy(F.lit(0)).orderBy("order_no")
    cum = F.sum("target").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = F.sum("target").over(W.partitionBy(F.lit(0)))
    cuts = targets.where("target > 0").select("order_no", "target", (cum / whole).alias("hi"), F.lag(cum / whole, 1, 0.0).over(order).alias("lo"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("order_no"))).alias("from_end"))
    cuts = cuts.withColumn("hi", F.when(F.col("from_end") == 1, F.lit(1.0)).otherwise(F.col("hi")))
    cells = cuts.select("order_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    n_slots = int(total) // block + SPARE
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.pmod(F.pmod("id", F.lit(TURN)) * F.lit(GOLDEN), F.lit(TURN)) / F.lit(float(TURN))).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    return points.join(cells, "cell").where("x >= lo AND x < hi").select("slot", "order_no")


def ranked(slots: DataFrame, rows: int = 65_536) -> DataFrame:
    """Adds rank: how many of the source's slots come before; two levels, so no source lands in one task."""
    slots = slots.withColumn("part", F.floor(F.col("slot") / rows))
    sums = slots.groupBy("order_no", "part").count()
    ahead = W.partitionBy("order_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("order_no", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = W.partitionBy("order_no", "part").orderBy("slot")
    return slots.withColumn("inside", F.row_number().over(inside) - 1).join(sums, ["order_no", "part"]).select("slot", "order_no", (F.col("before") + F.col("inside")).alias("rank"))


def completed(slots: DataFrame, sized: DataFrame, first: int, block: int = BLOCK) -> DataFrame:
    """slots (slot, order_no, rank) and, from slot ``first`` on, those that a source lacks for its quota (order_no, quota)."""
    have = slots.groupBy("order_no").agg(F.count("*").alias("have"))
    lack = sized.join(have, "order_no", "left").select("order_no", F.coalesce("have", F.lit(0)).alias("rank"), F.expr(f"(quota + {block - 1}) div {block} - coalesce(have, 0)").alias("lacking")).where("lacking > 0")
    ahead = W.partitionBy(F.lit(0)).orderBy("order_no").rowsBetween(W.unboundedPreceding, -1)
    lack = lack.withColumn("before", F.coalesce(F.sum("lacking").over(ahead), F.lit(0)))
    more = lack.select("order_no", "rank", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lacking") - 1)).alias("k"))
    return slots.unionByName(more.select((F.lit(first) + F.col("before") + F.col("k")).alias("slot"), "order_no", (F.col("rank") + F.col("k")).alias("rank")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3, block: int = BLOCK, text: str = "text", source: str = "source", store: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, documents).

    plan: slot, block, rid, doc_id, source, word_from, word_to: the words of the document that the slot takes, in
    the order of the schedule.  documents: block, rid, doc_id, source, size, source_size, target.  block and
    rid name the row (blocks.located).

    Null texts and texts of white space have size 0 and are never taken.  A null source is a source.
    Rows that repeat a doc_id are documents of their own.  Equal input gives equal output.  An empty
    table gives empty ones.
    """
    spark = docs.sparkSession
    store = store or Scratch(spark, "mix")
    base = located(docs, store, BLOCK_ROWS, [F.col("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")])
    rows = store.put(streams(base).drop("text"), "sizes")
    counted = rows.agg(F.count("*"), F.sum("size")).first()
    n_rows, total = int(counted[0]), int(counted[1] or 0)
    buckets = n_rows // BUCKET_ROWS + 1
    targets = store.put(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "targets")
    placed = store.put(
        with_positions(rows, buckets)
        .join(F.broadcast(targets.withColumnRenamed("source", "t_source")) if _few(targets) else targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source", "weight"),
        "positions",
    )
    store.drop(rows)
    sized = targets.select("order_no", "source_size", F.round("target").cast("long").alias("quota"))
    slots = completed(ranked(schedule(targets, total, block)), sized.select("order_no", "quota"), total // block + SPARE, block)
    taken = slots.join(F.broadcast(sized) if _few(targets) else sized, "order_no")
    # words [from, to) of the endless repetition of the stream, cut at the quota and at the stream's end
    taken = taken.select("slot", "order_no", "source_size", (F.col("rank") * block).alias("a"), F.least((F.col("rank") + 1) * block, F.col("quota")).alias("b")).where("b > a")
    turn = F.expr("a div source_size")
    spans = taken.select(
        "slot", "order_no",
        F.explode(
            F.transform(
                F.sequence(turn, F.expr("(b - 1) div source_size")),
                lambda t: F.struct((F.greatest(F.col("a"), t * F.col("source_size")) - t * F.col("source_size")).alias("x"), (F.least(F.col("b"), (t + 1) * F.col("source_size")) - t * F.col("source_size")).alias("y")),
            )
        ).alias("s"),
    ).select("slot", "order_no", "s.x", "s.y")
    # both sides are listed under the blocks of the stream that they touch
    left = spans.select("*", F.explode(F.sequence(F.expr(f"x div {block}"), F.expr(f"(y - 1) div {block}"))).alias("cell"))
    right = placed.where("size > 0").select(
        "block", "rid", "doc_id", "order_no", "source", "start", "size",
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("cell"),
    )
    from_ = F.greatest(F.col("x"), F.col("start"), F.col("cell") * block)
    to = F.least(F.col("y"), F.col("start") + F.col("size"), (F.col("cell") + 1) * block)
    plan = left.join(right, ["order_no", "cell"]).where(to > from_).select("slot", "block", "rid", "doc_id", "source", (from_ - F.col("start")).alias("word_from"), (to - F.col("start")).alias("word_to"))
    return plan, placed


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """Sources are few in practice; beyond ``most`` rows they are joined by a shuffle instead of a broadcast."""
    return targets.limit(most + 1).count() <= most


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """block, rid, doc_id, source, size, source_size, target, taken: the digest of mix() by row."""
    plan, placed = mix(docs, **options)
    words = plan.groupBy("block", "rid").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("words"))
    return placed.join(words, ["block", "rid"], "left").select(
        "block", "rid", "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_rows(docs).select("doc_id", "size", "source_size", "target", "taken")
