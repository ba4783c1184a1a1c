"""Sharding by Karmarkar-Karp differencing: equal texts stay together, bytes are balanced.

A partial partition is 16 sums, each with the groups behind it.  The two with the largest spread
(largest sum less smallest) are combined, the largest sum of one with the smallest of the other, until
one is left.  Groups are dealt to cells of about CELL_GROUPS by hash and each cell is differenced in a
task of its own; the cells' partial partitions, 16 numbers each, are then differenced in the same way
in tasks of FAN_IN, level by level, until one partition of everything is left.  Neither the driver nor
a task holds more than CELL_GROUPS groups or FAN_IN partial partitions.

A group is counted before it is shuffled, and its rows are numbered under salts, so a text that makes
up a third of all rows is one row of the differencing and many small keys of the numbering.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

SHARDS = 16
CELL_GROUPS = 16_384
FAN_IN = 4_096
SALT_ROWS = 16_384


def differencing(tuples: Sequence[Sequence[int]]) -> tuple[list[int], list[list[int]]]:
    """Combines partial partitions of equal width into one.

    Returns the final sums in falling order, and for each input tuple the place to which each of its
    entries went.
    """
    width = len(tuples[0])
    nodes: list[tuple] = []  # per node: for each sorted place, what it is made of
    heap = []
    for i, sums in enumerate(tuples):
        order = sorted(range(width), key=lambda k: (-sums[k], k))
        nodes.append((i, order))
        ranked = [sums[k] for k in order]
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [x[k] + y[width - 1 - k] for k in range(width)]
        order = sorted(range(width), key=lambda k: (-both[k], k))
        ranked = [both[k] for k in order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    placed: list[list[int]] = [[0] * width for _ in tuples]
    todo = [(heap[0][1], list(range(width)))]
    while todo:
        node, to = todo.pop()  # to: the final place of each of the node's places
        what = nodes[node]
        if len(what) == 2:
            for place, entry in enumerate(what[1]):
                placed[what[0]][entry] = to[place]
        else:
            a, b, order = what
            first, second = [0] * width, [0] * width
            for place, k in enumerate(order):
                first[k], second[width - 1 - k] = to[place], to[place]
            todo += [(a, first), (b, second)]
    return heap[0][2], placed


def _cell(shards: int):
    def run(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "digest"], ascending=[False, True], ignore_index=True)
        _, placed = differencing([[int(b)] + [0] * (shards - 1) for b in groups["bytes"]])
        groups["bin"] = [p[0] for p in placed]
        groups["ahead"] = groups.groupby("bin")["n"].cumsum() - groups["n"]
        return groups[["cell", "digest", "bytes", "n", "bin", "ahead"]]

    return run


def _level(shards: int):
    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        wide = bins.pivot(index="node", columns="bin", values="bytes").reindex(columns=range(shards)).fillna(0).sort_index()
        sums, placed = differencing([[int(v) for v in row] for row in wide.to_numpy()])
        out = [(int(key[0]), int(node), k, to[k], int(wide.iat[i, k])) for i, (node, to) in enumerate(zip(wide.index, placed, strict=True)) for k in range(shards)]
        return pd.DataFrame(out, columns=["parent", "node", "bin", "to", "bytes"])

    return run


def shard_bytes(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``.

    size: UTF-8 bytes and 1.  A null text counts, and is grouped, as an empty one.  Texts are equal if
    their lengths and MD5 digests are.  Rows that repeat a doc_id are rows of their own.  slot numbers a shard's
    rows without gaps from 0.  An empty table gives an empty one.
    """
    store = Scratch(docs.sparkSession, "shard")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = store.put(
        docs.select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.md5(body.cast("binary"))).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    n = rows.count()
    salts, cells = n // SALT_ROWS + 1, n // CELL_GROUPS + 1
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    parts = rows.groupBy("digest", "size", "salt").agg(F.count("*").alias("n"))
    groups = parts.groupBy("digest", "size").agg(F.sum("n").alias("n"))
    groups = groups.select(F.pmod(F.xxhash64("digest", "size"), F.lit(cells)).alias("cell"), "digest", (F.col("size") * F.col("n")).alias("bytes"), "n")
    placed = store.put(groups.groupBy("cell").applyInPandas(_cell(shards), "cell long, digest binary, bytes long, n long, bin int, ahead long"), "cells")
    bins = placed.groupBy("cell", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))

    nodes, at = bins.select(F.col("cell").alias("node"), "bin", "bytes"), cells
    where = bins.select("cell", F.col("cell").alias("node"), "bin", F.col("bin").alias("at"), "n")
    while True:
        moved = nodes.withColumn("parent", F.expr(f"node div {FAN_IN}")).groupBy("parent").applyInPandas(_level(shards), "parent long, node long, bin int, to int, bytes long")
        moved = store.put(moved, "level")
        step = moved.select(F.col("node").alias("from_node"), F.col("bin").alias("from_bin"), F.col("parent").alias("node"), "to")
        where = where.withColumnRenamed("node", "old").join(step, (F.col("old") == F.col("from_node")) & (F.col("at") == F.col("from_bin"))).select("cell", "node", "bin", F.col("to").alias("at"), "n")
        at = (at - 1) // FAN_IN + 1
        if at == 1:
            break
        nodes = moved.groupBy(F.col("parent").alias("node"), F.col("to").alias("bin")).agg(F.sum("bytes").alias("bytes"))
    base = W.partitionBy("at").orderBy("cell", "bin").rowsBetween(W.unboundedPreceding, -1)
    where = where.select("cell", "bin", F.col("at").alias("shard"), F.coalesce(F.sum("n").over(base), F.lit(0)).alias("base"))
    salted = W.partitionBy("digest", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        parts.withColumn("ahead_salts", F.coalesce(F.sum("n").over(salted), F.lit(0)))
        .join(placed.select("cell", "digest", "bin", "ahead", (F.expr("bytes div n")).alias("size")), ["digest", "size"])
        .join(where, ["cell", "bin"])
        .select("digest", "size", "salt", "shard", (F.col("base") + F.col("ahead") + F.col("ahead_salts")).alias("start"))
    )
    number = F.row_number().over(W.partitionBy("digest", "size", "salt").orderBy("row"))
    return rows.withColumn("number", number).join(starts, ["digest", "size", "salt"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("number") - 1).cast("long").alias("slot")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard_bytes(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
