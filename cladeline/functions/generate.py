"""Deterministic topologies, alignments and case grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .randomness import GAMMA, Stream, stream, unit
from .trees import Tree

SPLITS = ("balanced", "caterpillar", "beta-critical")
GROWTHS = ("yule", "uniform")
TOPOLOGIES = (*SPLITS, *GROWTHS)


def topology(kind: str, leaves: int, seed: int) -> np.ndarray:
    """Parent of each node (-1 at the root)."""
    if leaves < 2:
        raise ValueError("a tree has two leaves at least")
    if kind in GROWTHS:
        return _grown(kind, leaves, seed)
    if kind in SPLITS:
        return _split(kind, leaves, seed)
    raise ValueError(f"no topology {kind}")


def _grown(kind: str, leaves: int, seed: int) -> np.ndarray:
    """Each step hangs a new leaf on an inner node put above a random leaf (yule) or a random node (uniform)."""
    draws = stream(seed, leaves)
    parents = np.full(2 * leaves - 1, -1, np.int64)
    parents[1:3] = 0
    tips = [1, 2]
    for n in range(2, leaves):
        inner, tip = 2 * n - 1, 2 * n
        draw = int(draws[n - 2])
        below = tips[draw % n] if kind == "yule" else draw % (2 * n - 1)
        parents[inner], parents[below], parents[tip] = parents[below], inner, inner
        tips.append(tip)
    return parents


def _split(kind: str, leaves: int, seed: int) -> np.ndarray:
    """Divides the leaves from the root down, the left part first."""
    rng, parents, todo = Stream(seed), [], [(leaves, -1)]
    harmonic = np.r_[0.0, np.cumsum(1.0 / np.arange(1, leaves))]
    while todo:
        n, parent = todo.pop()
        node = len(parents)
        parents.append(parent)
        if n == 1:
            continue
        if kind == "balanced":
            left = n // 2
        elif kind == "caterpillar":
            left = 1 if rng.next() & 1 else n - 1
        else:
            # weight of i is 1 / (i (n - i)): a harmonic draw, reflected by a fair bit
            i = 1 + int(np.searchsorted(harmonic[1:n], rng.unit() * harmonic[n - 1], "left"))
            left = i if rng.next() & 1 else n - i
        todo += [(n - left, node), (left, node)]
    return np.array(parents, np.int64)


def numbered_lengths(edges: np.ndarray, seed: int) -> np.ndarray:
    """0.02 to 0.2 for each edge, from its number."""
    from .randomness import scramble

    return 0.02 + 0.18 * unit(scramble((np.uint64(seed) + edges.astype(np.uint64)) + np.uint64(GAMMA)))


def default_lengths(nodes: int, seed: int) -> np.ndarray:
    return numbered_lengths(np.arange(nodes), seed)


def simulate_jukes_cantor(tree: Tree, sites: int, seed: int, rate: float = 1.0) -> np.ndarray:
    """Masks [site, leaf]: one stream over all sites; a site draws the root and then one number for each edge, by breadth.

    A site's draws begin at a known place of the stream, so all sites are drawn at once.
    """
    if sites < 1:
        raise ValueError("a simulation has a site")
    order = tree.topological
    draws = stream(seed, sites * tree.size).reshape(sites, tree.size)
    states = np.zeros((sites, tree.size), np.int64)
    states[:, tree.root] = (draws[:, 0] & np.uint64(3)).astype(np.int64)
    u = unit(draws)
    other = -0.25 * np.expm1(-4.0 * rate * tree.lengths / 3.0)
    for k, v in enumerate(order[1:], 1):
        parent = states[:, tree.parents[v]]
        upto, state = np.zeros(sites), np.full(sites, 3)
        open_ = np.ones(sites, bool)
        for s in range(3):
            upto = upto + np.where(parent == s, 1.0 - 3.0 * other[v], other[v])
            hit = open_ & (u[:, k] < upto)
            state[hit] = s
            open_ &= ~hit
        states[:, v] = state
    return (1 << states[:, tree.leaves]).astype(np.uint8)


def _spelled(patterns: int, leaves: int | None = None) -> int:
    """Leaves whose states tell so many columns apart, of which there are ``leaves`` at most."""
    spelled = 0
    while (leaves is None or spelled < leaves) and 4**spelled < patterns:
        spelled += 1
    return spelled


def unique_patterns(spark: SparkSession, patterns: int, leaves: int, seed: int) -> DataFrame:
    """site, masks: distinct columns; the first leaves spell the column's number in base four, the rest is noise."""
    if patterns < 1 or leaves < 1 or 4 ** _spelled(patterns, leaves) < patterns:
        raise ValueError("there are not so many distinct columns")
    return spelled_patterns(spark, patterns, leaves, seed, _spelled(patterns))


def spelled_patterns(spark: SparkSession, patterns: int, leaves: int, seed: int, spelled: int | None = None) -> DataFrame:
    """site, masks of any number of columns: as unique_patterns, but the numbers' lower digits come again where there are more columns than
    the leaves can spell.  ``spelled`` is how many leaves spell, one at least if it is not given."""
    least = max(1, _spelled(patterns)) if spelled is None else spelled

    def draw(batches):
        for pdf in batches:
            site = pdf["id"].to_numpy(np.uint64)
            states = (stream(np.uint64(seed) ^ (site * np.uint64(GAMMA)), leaves) & np.uint64(3)).astype(np.uint8)
            for k in range(min(least, leaves)):
                states[:, k] = (site >> np.uint64(2 * k)) & np.uint64(3)
            yield pd.DataFrame({"site": pdf["id"], "masks": [bytes(m) for m in (1 << states).astype(np.uint8)]})

    return spark.range(patterns).mapInPandas(draw, "site long, masks binary")


def topologies(cases: DataFrame) -> DataFrame:
    """cases (kind, leaves, seed) -> one row a node, a tree being one task's work."""

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, leaves, seed = key
        parents = topology(kind, int(leaves), int(seed))
        return pd.DataFrame({"kind": kind, "leaves": leaves, "seed": seed, "node_id": np.arange(len(parents)), "parent_id": [int(p) if p >= 0 else None for p in parents]})

    return cases.select("kind", F.col("leaves").cast("long"), F.col("seed").cast("long")).distinct().groupBy("kind", "leaves", "seed").applyInPandas(grow, "kind string, leaves long, seed long, node_id long, parent_id long")


def case_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of the axes' values: a declared design, small by construction."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


# The axes of the studies of clock-like trees, by profile.
PROFILES = {
    "smoke": {"topology": ["balanced", "caterpillar", "yule", "beta-critical"], "leaves": [128, 512], "sites": [256, 1024], "height": [0.001, 0.1], "replicates": 3},
    "paper": {"topology": ["balanced", "caterpillar", "yule", "beta-critical"], "leaves": [128, 1024, 8192], "sites": [256, 2048, 8192], "height": [1e-4, 1e-3, 1e-2, 1e-1], "replicates": 10},
    "stress": {"topology": ["balanced", "caterpillar", "yule", "beta-critical"], "leaves": [100, 1000, 10000], "sites": [1000, 10000, 100000], "height": [1e-4, 1e-3, 1e-2, 1e-1], "replicates": 3},
}


def study_cases(spark: SparkSession, profile: str) -> DataFrame:
    """topology, leaves, sites, height, replicate of every case of a profile."""
    axes = dict(PROFILES[profile])
    return case_grid(spark, **{k: v for k, v in axes.items() if k != "replicates"}, replicate=list(range(axes["replicates"])))


def cyclic_schedule(spark: SparkSession, cases: int, methods: Sequence[str]) -> DataFrame:
    """record, case_no, order_no, method: each case runs every method, each starting one further."""
    m = len(methods)
    names = F.array(*[F.lit(x) for x in methods])
    rows = spark.range(cases * m).select(F.col("id").alias("record"), F.expr(f"id div {m}").alias("case_no"), F.pmod("id", F.lit(m)).alias("order_no"))
    return rows.withColumn("method", F.get(names, F.pmod(F.col("case_no") + F.col("order_no"), F.lit(m)).cast("int")))
