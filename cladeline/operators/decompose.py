"""Heavy paths of a tree whose nodes are rows, found in rounds that grow with the logarithms of its depth and size.

A node's heavy child is the one with most nodes below; a path follows heavy children.  Going from a path to the one its head
hangs under at least doubles the nodes below, so a walk to the root meets log2(n) paths at most, and the whole part of
log2(nodes below its head), the path's level, rises on the way.  Work that goes path by path can so go
level by level, however deep the tree is.

Sizes and places on paths come from pointer doubling: after k rounds a node knows of what lies 2^k steps away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.store import Store

#: Rows that meet in one stretch of a path, about: nodes, and the light children that hang there.
STRETCH = 1_024


@dataclass
class Paths:
    """A tree cut into heavy paths, as tables of a store.

    nodes: node_id, parent_id, path (the id of its head), pos (0 at the head), seg (its stretch), level, branch_length.
    paths: path, level, nodes, last_seg, and where the head hangs: t_node, t_path, t_pos, t_seg, t_level (null at the root).
    levels: (level, last stretch of any path there), rising.
    """

    nodes: DataFrame
    paths: DataFrame
    levels: list[tuple[int, int]]
    root: int
    size: int
    rounds: int


def _checked(nodes: DataFrame, store: Store) -> tuple[DataFrame, int, int]:
    length = F.coalesce("branch_length", F.lit(0.0)).cast("double")
    top = F.col("parent_id").isNull()
    rows = store.put(nodes.select(F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), F.when(top, 0.0).otherwise(length).alias("branch_length")), "tree")
    n, ids, roots, root = rows.agg(F.count("*"), F.count_distinct("node_id"), F.count_if(top), F.min(F.when(top, F.col("node_id")))).first()
    if not n or roots != 1:
        raise ValueError("a tree has one root")
    if ids != n:
        raise ValueError("a node occurs twice")
    if not rows.where("parent_id IS NOT NULL").join(rows.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti").isEmpty():
        raise ValueError("a parent is not in the tree")
    return rows, n, root


def _state(df: DataFrame, store: Store, name: str) -> tuple[DataFrame, bool]:
    """The table, and whether some of its nodes still have a pointer (up), as seen while it is written."""
    seen = Observation()
    out = store.put(df.observe(seen, F.count_if(F.col("up").isNotNull()).alias("open")), name)
    return out, bool(seen.get["open"])


def _sizes(rows: DataFrame, n: int, store: Store) -> tuple[DataFrame, int]:
    """node_id, size: nodes in the subtree, itself included; and the rounds it took."""
    (state, open_), rounds = _state(rows.select("node_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("size")), store, "sizes"), 0
    while open_:
        if n >> rounds == 0:
            raise ValueError("not a tree: some nodes never reach the root")
        more = state.where("up IS NOT NULL").groupBy("up").agg(F.sum("size").alias("more")).withColumnRenamed("up", "node_id")
        ahead = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"))
        moved = state.where("up IS NOT NULL").join(ahead, "up").select("node_id", "next", "size").unionByName(state.where("up IS NULL").select("node_id", F.col("up").alias("next"), "size"))
        after, open_ = _state(moved.join(more, "node_id", "left").select("node_id", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), store, "sizes")
        store.drop(state)
        state, rounds = after, rounds + 1
    return state.select("node_id", "size"), rounds


def _places(rows: DataFrame, store: Store) -> tuple[DataFrame, int]:
    """rows (node_id, up: the parent where it continues the parent's path, weight) -> node_id, path, pos, before (weights above it on the path)."""
    zero = F.lit(0).cast("long")
    (state, open_), rounds = _state(rows.select("node_id", "up", F.col("node_id").alias("path"), zero.alias("pos"), zero.alias("before"), "weight"), store, "places"), 0
    while open_:
        ahead = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("p"), F.col("pos").alias("q"), (F.col("before") + F.col("weight")).alias("b"))
        moved = state.where("up IS NOT NULL").join(ahead, "up").select("node_id", F.col("next").alias("up"), F.col("p").alias("path"), (F.col("pos") + F.col("q") + 1).alias("pos"), (F.col("before") + F.col("b")).alias("before"), "weight")
        after, open_ = _state(moved.unionByName(state.where("up IS NULL")), store, "places")
        store.drop(state)
        state, rounds = after, rounds + 1
    return state.drop("up"), rounds


def heavy_paths(nodes: DataFrame, store: Store, stretch: int = STRETCH) -> Paths:
    """nodes (node_id, parent_id, branch_length) cut into paths.  Ties go to the smaller node_id; a missing length is 0, as is the root's.

    Several or no roots, a node given twice, a parent that is not there and a cycle are errors.
    A node with very many light children has stretches of its own, among which they are dealt.
    """
    rows, n, root = _checked(nodes, store)
    sizes, r1 = _sizes(rows, n, store)
    sized = store.put(rows.join(sizes, "node_id"), "sized")
    best = sized.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.max(F.struct("size", (-F.col("node_id")).alias("id"))).alias("best"), F.count("*").alias("kids"))
    best = store.put(best.select("parent_id", (-F.col("best.id")).alias("heavy"), "kids"), "heavy")
    own = best.select(F.col("parent_id").alias("node_id"), F.col("kids").alias("weight"))  # itself and its light children
    linked = sized.join(best.select("parent_id", "heavy"), "parent_id", "left").join(own, "node_id", "left")
    linked = linked.select("node_id", F.when(F.col("heavy") == F.col("node_id"), F.col("parent_id")).alias("up"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))
    placed, r2 = _places(linked, store)
    level = F.floor(F.log2(F.col("size").cast("double")) + 1e-12).cast("int")
    heads = sized.select(F.col("node_id").alias("path"), level.alias("level"))
    seg = F.expr(f"before div {stretch}")
    out = sized.join(placed, "node_id").join(heads, "path")
    out = store.put(out.select("node_id", "parent_id", "path", "pos", seg.alias("seg"), "level", "branch_length", F.greatest(F.lit(1), F.expr(f"weight div {stretch}")).alias("segs")), "nodes")
    per_path = out.groupBy("path", "level").agg(F.count("*").alias("nodes"), F.max(F.col("seg") + F.col("segs") - 1).alias("last_seg"))
    hang = out.select(F.col("node_id").alias("t_node"), F.col("path").alias("t_path"), F.col("pos").alias("t_pos"), F.col("seg").alias("base"), "segs", F.col("level").alias("t_level"))
    under = out.where("pos = 0").select("path", F.col("parent_id").alias("t_node"))
    dealt = F.when(F.col("segs") > 1, F.col("base") + F.pmod(F.xxhash64("path"), F.col("segs"))).otherwise(F.col("base"))
    paths = per_path.join(under, "path").join(hang, "t_node", "left").select("path", "level", "nodes", "last_seg", "t_node", "t_path", "t_pos", dealt.alias("t_seg"), "t_level")
    paths = store.put(paths, "paths")
    levels = sorted((r["level"], r["last"]) for r in paths.groupBy("level").agg(F.max("last_seg").alias("last")).collect())
    store.drop(rows, sized, best)
    return Paths(out.drop("segs"), paths, levels, root, n, r1 + r2)


def distances(nodes: DataFrame, lengths: str = "branch_length") -> DataFrame:
    """Adds x: the sum of lengths from the path's top edge down to the node.  By stretches, so that no task holds a path."""
    sums = nodes.groupBy("path", "seg").agg(F.sum(lengths).alias("sum"))
    above = F.sum("sum").over(W.partitionBy("path").orderBy("seg").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("path", "seg", F.coalesce(above, F.lit(0.0)).alias("above"))
    inside = F.sum(lengths).over(W.partitionBy("path", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return nodes.join(sums, ["path", "seg"]).withColumn("x", inside + F.col("above")).drop("above")


def root_distances(nodes: DataFrame, store: Store) -> DataFrame:
    """node_id, distance, depth: the summed lengths and the number of edges from the root, in as many rounds as the depth has binary digits."""
    rows, n, _ = _checked(nodes, store)
    first = rows.select("node_id", F.col("parent_id").alias("up"), F.col("branch_length").alias("distance"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    (state, open_), rounds = _state(first, store, "far"), 0
    while open_:
        if n >> rounds == 0:
            raise ValueError("not a tree: some nodes never reach the root")
        ahead = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("distance").alias("more"), F.col("depth").alias("deeper"))
        moved = state.where("up IS NOT NULL").join(ahead, "up").select("node_id", F.col("next").alias("up"), (F.col("distance") + F.col("more")).alias("distance"), (F.col("depth") + F.col("deeper")).alias("depth"))
        after, open_ = _state(moved.unionByName(state.where("up IS NULL")), store, "far")
        store.drop(state)
        state, rounds = after, rounds + 1
    return state.drop("up")


def tree_shape(nodes: DataFrame, store: Store) -> DataFrame:
    """leaves, height (edges to the deepest) and sackin (the sum of the leaves' depths)."""
    inner = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id")).distinct()
    depths = root_distances(nodes, store).join(inner, "node_id", "left_anti")
    return depths.agg(F.count("*").alias("leaves"), F.max("depth").alias("height"), F.sum("depth").alias("sackin"))
