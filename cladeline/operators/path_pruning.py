"""Likelihoods and marginals of trees beyond one task: messages along heavy paths, composed as 4 x 4 matrices.

A row is a factor of one site and category at a place on a path: an observation, or the message of a path that hangs
there.  Nodes without one need no row, as transitions over consecutive edges compose to the transition over their summed length.
The factors of a stretch multiply, in the order of the path, to a matrix; a path's matrices to one; that sends a message to the node
its head hangs under.  Paths of one level are worked off together, so there are log2(nodes) levels at most and two
exchanges of rows in each, whatever the depth.  Inside messages are kept, by a digest of everything they depend
on; marginals come down the same paths from them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import NucleotideModel, RateMixture, exponentials, rate_matrix
from ..sources.store import Store
from .decompose import STRETCH, Paths, distances, heavy_paths
from .kernels import EMISSION

#: Rows that one call of NumPy gets, about.
GROUP_ROWS = 50_000
#: Observations of leaves that a task adds up by place before it sends them.
TIP_ROWS = 500_000
_L = ["l0", "l1", "l2", "l3"]
_A = [f"a{i}{j}" for i in range(4) for j in range(4)]
_Q, _H = [f"q{i}" for i in range(4)], [f"h{i}" for i in range(4)]
_doubles = lambda names: ", ".join(f"{c} double" for c in names)
#: A factor: from x0 to x1 on its path, the matrix a and the logarithm of its scale.
_FACTOR = f"site long, c int, path long, level int, seg long, x0 double, x1 double, {_doubles(_A)}, scale double"
_KEY = ["site", "c", "path", "seg"]
#: What leaves say that hang at one place, added up: kind 0; or one of them alone: kind 1, ref its path.
_TIP_KEY = ["site", "c", "path", "seg", "pos", "x", "kind", "ref"]
_TIP = f"site long, c int, path long, seg long, pos long, x double, kind int, ref long, {_doubles(_L)}"


class _Transitions:
    """Transition matrices by length and category, each distinct one worked out once a call."""

    def __init__(self, model: NucleotideModel, mixture: RateMixture):
        self.q = rate_matrix(model)
        self.rates = np.array([model.rate * mixture.rate(c) for c in range(mixture.count)])

    def __call__(self, lengths: np.ndarray, category: np.ndarray) -> np.ndarray:
        times, at = np.unique(np.maximum(lengths, 0.0) * self.rates[category], return_inverse=True)
        return exponentials(self.q, times)[at]


def _matrix(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in names], axis=1)


def _long(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().astype(np.int64) for c in names]


class _Runs:
    """Rows sorted by group and place, walked place by place over all groups at once, the longest groups first."""

    def __init__(self, keys: list[np.ndarray], place: list[np.ndarray]):
        self.order = np.lexsort((*reversed(place), *reversed(keys)))
        keys = [k[self.order] for k in keys]
        n = len(self.order)
        new = np.zeros(n, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.r_[self.first, n])
        self.group = np.cumsum(new) - 1
        self.long = np.argsort(-self.count, kind="stable")

    def forward(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(step, groups that have a row there, those rows)."""
        counts = self.count[self.long]
        for t in range(int(counts[0]) if len(counts) else 0):
            live = self.long[: int(np.searchsorted(-counts, -t, "left"))]
            yield t, live, self.first[live] + t

    def backward(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        counts = self.count[self.long]
        for t in range(int(counts[0]) if len(counts) else 0):
            live = self.long[: int(np.searchsorted(-counts, -t, "left"))]
            yield t, live, self.first[live] + self.count[live] - 1 - t


def _normal(a: np.ndarray, axes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled to a largest entry of 1, and the logarithms of the scales; what is all 0 stays so, with a scale of -inf."""
    top = a.max(axis=axes, keepdims=True)
    with np.errstate(divide="ignore"):
        return a / np.where(top > 0, top, 1.0), np.log(top.reshape(top.shape[0]))


def _diagonals(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row factors of logarithms l0..l3 as vectors of largest entry 1, and the logarithms of their scales."""
    l = _matrix(rows, _L)
    top = l.max(axis=1)
    return np.exp(l - np.where(np.isfinite(top), top, 0.0)[:, None]), top


def _fold(step: Callable, rows: pa.Table, stretch: int) -> pa.Table:
    """Factors -> one factor a group: the product along the path."""
    site, c, path, level, seg = _long(rows, "site", "c", "path", "level", "seg")
    plain = "pos" in rows.column_names
    if plain:
        d, scale = _diagonals(rows)
        a = d[:, :, None] * np.eye(4)
        x0 = x1 = rows.column("x").to_numpy()
        runs = _Runs([site, c, path, seg], [*_long(rows, "pos")])
        to = seg
    else:
        a, scale = _matrix(rows, _A).reshape(-1, 4, 4), rows.column("scale").to_numpy()
        x0, x1 = rows.column("x0").to_numpy(), rows.column("x1").to_numpy()
        to = seg // stretch
        runs = _Runs([site, c, path, to], [seg])
    site, c, path, level, to, a, scale, x0, x1 = (v[runs.order] for v in (site, c, path, level, to, a, scale, x0, x1))
    if plain:
        d = d[runs.order]
    gaps = np.r_[0.0, x0[1:] - x1[:-1]] if len(x0) else x0
    gaps[runs.first] = 0.0
    m = step(gaps, c)
    total, logs = a[runs.first].copy(), np.add.reduceat(scale, runs.first) if len(scale) else scale
    for t, live, at in runs.forward():
        if t:
            product = np.matmul(total[live], m[at])
            product = product * d[at][:, None, :] if plain else np.matmul(product, a[at])
            total[live], more = _normal(product, (1, 2))
            with np.errstate(invalid="ignore"):
                logs[live] = np.where(np.isneginf(more), -np.inf, logs[live] + more)
    last = runs.first + runs.count - 1
    names = ["site", "c", "path", "level", "seg", "x0", "x1", *_A, "scale"]
    columns = [site[runs.first], c[runs.first].astype(np.int32), path[runs.first], level[runs.first].astype(np.int32), to[runs.first], x0[runs.first], x1[last], *total.reshape(-1, 16).T, logs]
    return pa.table([pa.array(x) for x in columns], names=names)


def _message(step: Callable, rows: pa.Table) -> pa.Table:
    """One factor a path -> what it says of the state at the other end of its top edge: l0..l3."""
    c = _long(rows, "c")[0]
    v = np.matmul(step(rows.column("x0").to_numpy(), c), _matrix(rows, _A).reshape(-1, 4, 4)).sum(axis=2)
    with np.errstate(divide="ignore"):
        l = np.log(v) + rows.column("scale").to_numpy()[:, None]
    return pa.table([rows.column("site"), rows.column("c"), rows.column("path"), *[pa.array(x) for x in l.T]], names=["site", "c", "path", *_L])


def _said(step: Callable, categories: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Observed leaves that hang on paths (mask, length; path, seg, pos and x of the place) -> what they say there, added up."""
    keys = _long(rows, "site", "path", "seg", "pos", "kind", "ref")
    order = np.lexsort(keys[::-1])
    first = np.flatnonzero(np.any([np.r_[True, k[order][1:] != k[order][:-1]] for k in keys], axis=0))
    lengths, number = np.unique(rows.column("length").to_numpy(), return_inverse=True)
    which = (number * 16 + _long(rows, "mask")[0])[order]
    site, path, seg, pos, kind, ref = (k[order[first]] for k in keys)
    x = rows.column("x").to_numpy()[order[first]]
    for c in range(categories):
        with np.errstate(divide="ignore"):
            table = np.log(np.matmul(EMISSION, step(lengths, np.full(len(lengths), c)).swapaxes(-1, -2))).reshape(-1, 4)  # [length and mask, parent state]
        total = np.add.reduceat(table.take(which, axis=0), first, axis=0)
        columns = [site, np.full(len(first), c, np.int32), path, seg, pos, x, kind.astype(np.int32), ref, *np.ascontiguousarray(total.T)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=[*_TIP_KEY, *_L])


def _tips(step: Callable, categories: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TIP_ROWS:
                yield from _said(step, categories, pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from _said(step, categories, pa.Table.from_batches(held))

    return run


def _scan(step: Callable, rows: pa.Table, stretch: int) -> pa.Table:
    """Factors, each with what comes from above (q at xq) and below (h at xh) its group -> the same for each of them.

    q: by state at xq, the weight of everything above the group; h: by state at xh, that of everything below it.
    """
    site, c, path, seg = _long(rows, "site", "c", "path", "seg")
    plain = "pos" in rows.column_names
    if plain:
        a = None
        d, _ = _diagonals(rows)
        x0 = x1 = rows.column("x").to_numpy()
        runs = _Runs([site, c, path, seg], _long(rows, "pos", "kind"))
    else:
        a = _matrix(rows, _A).reshape(-1, 4, 4)
        x0, x1 = rows.column("x0").to_numpy(), rows.column("x1").to_numpy()
        runs = _Runs([site, c, path, seg // stretch], [seg])
    rows = rows.take(pa.array(runs.order))
    c, x0, x1 = c[runs.order], x0[runs.order], x1[runs.order]
    q, xq, h, xh = _matrix(rows, _Q), rows.column("xq").to_numpy().copy(), _matrix(rows, _H), rows.column("xh").to_numpy().copy()
    inner = np.ones(len(x0), bool)
    inner[runs.first] = False
    at_inner = np.flatnonzero(inner)
    xq[at_inner], xh[at_inner - 1] = x1[at_inner - 1], x0[at_inner]
    above, below = step(x0 - xq, c), step(np.where(np.isfinite(xh), xh - x1, 0.0), c)
    own = d[runs.order] if plain else a[runs.order]
    right = (lambda v, at: v * own[at]) if plain else (lambda v, at: np.matmul(v[:, None], own[at])[:, 0])
    left = (lambda v, at: v * own[at]) if plain else (lambda v, at: np.matmul(own[at], v[:, :, None])[:, :, 0])
    for t, _, at in runs.forward():
        if t:
            q[at] = _normal(right(np.matmul(q[at - 1][:, None], above[at - 1])[:, 0], at - 1), (1,))[0]
    for t, _, at in runs.backward():
        if t:
            h[at] = _normal(left(np.matmul(below[at + 1], h[at + 1][:, :, None])[:, :, 0], at + 1), (1,))[0]
    for name, values in [*zip(_Q, q.T, strict=True), ("xq", xq), *zip(_H, h.T, strict=True), ("xh", xh)]:
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(np.ascontiguousarray(values)))
    return rows


def _spread(step: Callable, rows: pa.Table, stretch: int) -> pa.Table:
    """Row factors with what is above and below their group -> for each wanted node the joint of its parent's and its own state,
    for each path that hangs there the weights by state of everything but it."""
    rows = _scan(step, rows, stretch)
    c, kind = _long(rows, "c", "kind")
    x = rows.column("x").to_numpy()
    q, h = _matrix(rows, _Q), _matrix(rows, _H)
    xh = rows.column("xh").to_numpy()
    above = step(x - rows.column("xq").to_numpy(), c)
    under = np.matmul(step(np.where(np.isfinite(xh), xh - x, 0.0), c), h[:, :, None])[:, :, 0]
    d, _ = _diagonals(rows)
    joint = q[:, :, None] * above * (d * under)[:, None, :]
    rest, _ = _normal(np.matmul(q[:, None], above)[:, 0] * under, (1,))
    hangs = kind == 1
    pick = np.flatnonzero(hangs | rows.column("wanted").to_numpy(zero_copy_only=False).astype(bool))
    values = np.where(hangs[:, None], np.pad(rest, ((0, 0), (0, 12))), joint.reshape(-1, 16))[pick]
    out = [rows.column(n).take(pa.array(pick)) for n in ("site", "c", "kind", "ref")]
    return pa.table([*out, *[pa.array(np.ascontiguousarray(v)) for v in values.T]], names=["site", "c", "kind", "ref", *_A])


def _log_sum(values: list, weights: list | None = None):
    """The logarithm of the weighted sum of exponentials of columns; -Infinity if none is possible."""
    top = F.greatest(*values)
    total = sum((F.exp(v - top) * (1.0 if weights is None else w) for v, w in zip(values, weights or values, strict=True)), F.lit(0.0))
    return F.when(top == float("-inf"), top).otherwise(F.when(total > 0, F.ln(total)).otherwise(float("-inf")) + top)


class PathPruning:
    """Evaluations of one tree and its observations; lengths may change between them, and what they do not touch is kept.

    observations: site, node_id, mask (1 to 15); nodes without one are unknown, and several of one site and node all hold.
    The tree and the tables on the way lie in ``store``, whose owner closes it.
    """

    def __init__(self, nodes: DataFrame, observations: DataFrame, model: NucleotideModel, mixture: RateMixture | None, store: Store, stretch: int = STRETCH):
        self.model, self.mixture, self.store, self.stretch = model.validate(), mixture or RateMixture(), store, stretch
        self.step = _Transitions(model, self.mixture)
        self.paths: Paths = heavy_paths(nodes, store, stretch)
        mask = F.when(F.col("mask").between(1, 15), F.col("mask")).otherwise(F.raise_error(F.lit("a mask is 1 to 15")))
        place = self.paths.nodes.select("node_id", "path", "pos", "seg", "level")
        seen = observations.select(F.col("site").cast("long").alias("site"), F.col("node_id").cast("long").alias("node_id"), mask.alias("mask"))
        seen = seen.groupBy("site", "node_id").agg(F.bit_and("mask").alias("mask")).join(place, "node_id", "left")
        path = F.when(F.col("path").isNull(), F.raise_error(F.lit("an observed node is not in the tree"))).otherwise(F.col("path"))
        # a path of level 0 is one leaf; if it hangs on another, what it says needs no factors
        self.tips = self.paths.levels[0][0] == 0 and len(self.paths.levels) > 1
        seen = store.put(seen.withColumn("path", path).withColumn("tip", (F.col("level") == 0) & F.lit(self.tips)), "observations", ["tip"])
        self.seen, self.seen_tips = seen.where("not tip").drop("tip"), seen.where("tip").drop("tip")
        self.own_rows = self.seen.count() * self.mixture.count
        self.rows = max(1, self.own_rows)
        self.said_tips: list[DataFrame] = []  # by place, with the digests of the paths that the places are on
        self.kept: dict[int, list[DataFrame]] = {level: [] for level, _ in self.paths.levels}  # messages by level, with their digests
        self.known: DataFrame | None = None  # path, digest of all kept messages
        self.totals: DataFrame | None = None
        self.recomputed = {"paths": 0, "nodes": 0}

    # digests

    def _digests(self, nodes: DataFrame) -> DataFrame:
        """path, digest of what its message depends on: the model, its edges and theirs who hang there."""
        own = nodes.groupBy("path").agg(F.bit_xor(F.xxhash64("node_id", "pos", "branch_length")).alias("own"))
        rows = self.store.put(self.paths.paths.select("path", "level", "t_path", "t_level").join(own, "path"), "own")
        model = F.lit(repr((self.model, self.mixture)))
        found, below = None, None
        for level, _ in self.paths.levels:
            here = rows.where(F.col("level") == level)
            if below is not None:
                kids = below.where(F.col("t_level") == level).groupBy(F.col("t_path").alias("path")).agg(F.bit_xor(F.xxhash64("path", "digest")).alias("kids"))
                here = here.join(kids, "path", "left")
            else:
                here = here.withColumn("kids", F.lit(None).cast("long"))
            here = self.store.put(here.select("path", "level", "t_path", "t_level", F.xxhash64(model, "own", F.coalesce("kids", F.lit(0))).alias("digest")), "digests")
            below = here if below is None else below.unionByName(here)
            found = below
        return self.store.put(found.select("path", "digest"), "all-digests")

    # inside

    def _grouped(self, rows: DataFrame, keys: list, run: Callable, schema: str, least: int | None = None) -> DataFrame:
        """run(table) over whole groups, several to a call."""
        calls = max(1, (least or self.rows) // GROUP_ROWS)
        return rows.withColumn("call", F.pmod(F.xxhash64(*keys), F.lit(calls))).groupBy("call").applyInArrow(run, schema)

    def _hung_tips(self, hung: DataFrame, alone: DataFrame | None = None) -> DataFrame:
        """What observed leaves say where they hang, added up by place; those in ``alone`` (site, path) one by one.  hung: rows of current."""
        length = self.placed.where(F.col("level") == 0).select(F.col("node_id").alias("path"), F.col("x").alias("length"))
        rows = self.seen_tips.select("site", "path", "mask").join(hung.where(F.col("level") == 0).select("path", "t_path", "t_seg", "t_pos", "t_x").join(length, "path"), "path")
        rows = rows.withColumn("kind", F.lit(0)) if alone is None else rows.join(alone.withColumn("kind", F.lit(1)), ["site", "path"], "left")
        own = F.col("kind") == 1
        rows = rows.select("site", F.col("t_path").alias("path"), F.col("t_seg").alias("seg"), F.col("t_pos").alias("pos"), F.col("t_x").alias("x"), F.coalesce("kind", F.lit(0)).alias("kind"), F.when(own, F.col("path")).otherwise(F.lit(0)).cast("long").alias("ref"), "length", "mask")
        said = rows.mapInArrow(_tips(self.step, self.mixture.count), _TIP).groupBy(*_TIP_KEY).agg(*[F.sum(l).alias(l) for l in _L])
        return said.join(self.current.select("path", "level", "digest"), "path")

    def _factors(self, level: int, nodes: DataFrame, wanted: DataFrame | None = None, tips: list[DataFrame] | None = None) -> DataFrame:
        """The row factors of paths of a level: observations (kind 0, ref the node), messages (kind 1, ref their path), and what leaves say."""
        cells = lambda s: F.when(F.col("mask").bitwiseAND(F.lit(1 << s)) != 0, 0.0).otherwise(float("-inf")).alias(f"l{s}")
        x = nodes.where(F.col("level") == level).select("node_id", "x", F.col("path").alias("p"))
        seen = (self.seen_tips if self.tips and level == 0 else self.seen).where(F.col("level") == level).withColumn("wanted", F.lit(False))
        if wanted is not None:
            seen = seen.unionByName(wanted.where(F.col("level") == level))
        seen = seen.join(x.select("node_id", "x"), "node_id").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(self.mixture.count - 1))))
        seen = seen.select("site", "c", "path", "level", "seg", "pos", "x", *[cells(s) for s in range(4)], F.lit(0).alias("kind"), F.col("node_id").alias("ref"), "wanted")
        for table in self.said_tips if tips is None else tips:
            table = table.where(F.col("level") == level).join(self.current.select("path", "digest"), ["path", "digest"])
            seen = seen.unionByName(table.select("site", "c", "path", "level", "seg", "pos", "x", *_L, "kind", "ref", F.lit(False).alias("wanted")))
        lower = [m for below, tables in self.kept.items() if below < level for m in tables]
        if not lower:
            return seen
        hung = self.current.where(F.col("t_level") == level).select("path", "digest", F.col("t_path").alias("p"), "t_seg", "t_pos", F.col("t_x").alias("x"))
        for k, table in enumerate(lower):
            lower[k] = table.where(F.col("t_level") == level).drop("t_level").join(hung, ["path", "digest"])
        said = lower[0]
        for table in lower[1:]:
            said = said.unionByName(table)
        said = said.select("site", "c", F.col("p").alias("path"), F.lit(level).alias("level"), F.col("t_seg").alias("seg"), F.col("t_pos").alias("pos"), "x", *_L, F.lit(1).alias("kind"), F.col("path").alias("ref"), F.lit(False).alias("wanted"))
        return seen.unionByName(said)

    def _folded(self, rows: DataFrame, last: int) -> list[DataFrame]:
        """Factors by stretch, by stretch of stretches, and so on; the last are one a path."""
        step, stretch = self.step, self.stretch
        out = [self.store.put(self._grouped(rows, _KEY, lambda t: _fold(step, t, stretch), _FACTOR), "factors")]
        while last:
            last //= stretch
            up = [*_KEY[:3], F.expr(f"seg div {stretch}")]
            out.append(self.store.put(self._grouped(out[-1], up, lambda t: _fold(step, t, stretch), _FACTOR), "factors"))
        return out

    def evaluate(self, lengths: DataFrame | None = None) -> DataFrame:
        """site, log_likelihood.  lengths (node_id, branch_length) replaces those of some nodes, from now on.

        Only paths with a changed length below or on them are worked out; ``recomputed`` says how many, and their nodes.
        """
        nodes = self.paths.nodes
        if lengths is not None:
            new = lengths.select(F.col("node_id").cast("long").alias("node_id"), F.col("branch_length").cast("double").alias("new"))
            nodes = nodes.join(new, "node_id", "left").withColumn("branch_length", F.when(F.col("parent_id").isNull(), 0.0).otherwise(F.coalesce("new", "branch_length"))).drop("new")
            self.paths.nodes = nodes = self.store.put(nodes, "nodes")
        self.placed = placed = self.store.put(distances(nodes), "places")
        digests = self._digests(nodes)
        at = placed.select(F.col("node_id").alias("t_node"), F.col("x").alias("t_x"))
        self.current = self.store.put(self.paths.paths.join(digests, "path").join(at, "t_node", "left"), "current")
        todo = self.current.select("path", "digest", "nodes", "level")
        if self.known is not None:
            todo = todo.join(self.known, ["path", "digest"], "left_anti")
        todo = self.store.put(todo, "todo")
        self.recomputed = {"paths": 0, "nodes": 0} | {k: v or 0 for k, v in todo.agg(F.count("*").alias("paths"), F.sum("nodes").alias("nodes")).first().asDict().items()}
        step = self.step
        if self.tips:
            hung = self.current if self.known is None else self.current.join(todo.select(F.col("path").alias("t_path")), "t_path", "left_semi")
            self.said_tips.append(self.store.put(self._hung_tips(hung), "tips"))
            self.rows = max(self.rows, self.own_rows + self.said_tips[-1].count())
        for level, last in self.paths.levels[1:] if self.tips else self.paths.levels:
            rows = self._factors(level, placed)
            if self.known is not None:
                rows = rows.join(todo.where(F.col("level") == level).select("path"), "path", "left_semi")
            whole = self._folded(rows, last)[-1]
            said = self._grouped(whole, ["site", "c", "path"], lambda t: _message(step, t), f"site long, c int, path long, {_doubles(_L)}")
            said = said.join(self.current.select("path", "digest", "t_level"), "path")
            self.kept[level].append(self.store.put(said, "messages", ["t_level"]))
        self.known = self.store.put(todo.select("path", "digest") if self.known is None else self.known.unionByName(todo.select("path", "digest")), "known")
        self.by_category = self._root()
        return self._sites(self.by_category)

    def _root(self) -> DataFrame:
        """site, c, l: the logarithm of each category's share of the likelihood."""
        top = self.current.where("t_path IS NULL").select("path", "digest")
        tables = [m.where("t_level IS NULL").drop("t_level").join(top, ["path", "digest"]) for m in self.kept[self.paths.levels[-1][0]]]
        said = tables[0]
        for t in tables[1:]:
            said = said.unionByName(t)
        weight = F.element_at(F.array(*[F.lit(math.log(self.mixture.weight(c))) for c in range(self.mixture.count)]), F.col("c") + 1)
        # the message of the path at the top has crossed no edge, so its states are the root's
        return self.store.put(said.select("site", "c", (_log_sum([F.col(x) for x in _L], [F.lit(float(p)) for p in self.model.root]) + weight).alias("l")), "categories")

    @staticmethod
    def _sites(by_category: DataFrame) -> DataFrame:
        top = by_category.groupBy("site").agg(F.max("l").alias("top"), F.collect_list("l").alias("l"))
        total = F.aggregate("l", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
        return top.select("site", F.when(F.col("top") == float("-inf"), F.col("top")).otherwise(F.ln(total) + F.col("top")).alias("log_likelihood"))

    # outside

    def _needed(self, places: DataFrame) -> DataFrame:
        """site, path, level: where the wanted nodes are, and all paths above."""
        paths = self.paths.paths.select("path", "level", "t_path", "t_level").where("t_path IS NOT NULL")
        need = self.store.put(places.select("site", "path", "level").distinct(), "needed")
        for level, _ in self.paths.levels:
            up = need.where(F.col("level") == level).join(paths.drop("level"), "path").select("site", F.col("t_path").alias("path"), F.col("t_level").alias("level"))
            after = self.store.put(need.unionByName(up).distinct(), "needed")
            self.store.drop(need)
            need = after
        return need

    def _silent(self, level: int, need: DataFrame, rows: DataFrame) -> DataFrame:
        """Row factors that say nothing, for needed paths that hang on a level and send no message."""
        hung = self.current.where(F.col("t_level") == level).select("path", F.col("t_path").alias("p"), "t_seg", "t_pos", F.col("t_x").alias("x"))
        asked = need.select("site", "path").join(hung, "path").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(self.mixture.count - 1))))
        asked = asked.select("site", "c", F.col("p").alias("path"), F.lit(level).alias("level"), F.col("t_seg").alias("seg"), F.col("t_pos").alias("pos"), "x", *[F.lit(0.0).alias(l) for l in _L], F.lit(1).alias("kind"), F.col("path").alias("ref"), F.lit(False).alias("wanted"))
        return asked.join(rows.where("kind = 1").select("site", "c", "ref"), ["site", "c", "ref"], "left_anti").select(rows.columns)

    def edge_marginals(self, wanted: DataFrame) -> DataFrame:
        """site, child_id, parent_state, child_state, p for each wanted (site, node_id) but the root; after evaluate()."""
        return self._marginals(wanted)[1]

    def node_marginals(self, wanted: DataFrame) -> DataFrame:
        """site, node_id, state, p for each wanted (site, node_id); after evaluate().  Sites that cannot occur, and those without any observation, are left out."""
        return self._marginals(wanted)[0]

    def _marginals(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        store, step, stretch = self.store, self.step, self.stretch
        place = self.paths.nodes.select("node_id", "parent_id", "path", "pos", "seg", "level")
        asked = store.put(wanted.select(F.col("site").cast("long").alias("site"), F.col("node_id").cast("long").alias("node_id")).distinct().join(place, "node_id"), "asked")
        # a node's parent gets a factor of its own, so that the factor before the node's is its parent's
        above = asked.where("pos > 0").select("site", F.col("parent_id").alias("node_id")).distinct().join(place, "node_id")
        blank = asked.withColumn("wanted", F.lit(True)).unionByName(above.withColumn("wanted", F.lit(False))).withColumn("mask", F.lit(15))
        blank = store.put(blank.select("site", "node_id", "mask", "path", "pos", "seg", "level", "wanted"), "blank")
        need = self._needed(asked)
        root, found, down = self.model.root, [], None
        where = {r["level"] for r in need.select("level").distinct().collect()}
        tips = None
        if self.tips and 0 in where:
            tips = [store.put(self._hung_tips(self.current, need.where("level = 0").select("site", "path")), "tips")]
        for level, last in reversed(self.paths.levels):
            if level not in where and found:
                continue
            rows = self._factors(level, self.placed, blank, tips)
            rows = rows.unionByName(self._silent(level, need, rows)).join(need.where(F.col("level") == level).select("site", "path"), ["site", "path"], "left_semi")
            rows = rows.withColumn("kind", F.when(F.col("wanted"), -1).otherwise(F.col("kind")))
            rows = store.put(rows, "down-rows")
            n = rows.count()
            folded = self._folded(rows, last)[:-1] if last else []
            tops = rows.select("site", "c", "path").distinct()
            if down is None:
                given = tops.select("*", *[F.lit(float(p)).alias(q) for p, q in zip(root, _Q, strict=True)])
            else:
                given = tops
                for part in down:
                    part = part.where("kind = 1").select("site", "c", F.col("ref").alias("path"), *[F.col(a).alias(q) for a, q in zip(_A, _Q, strict=False)])
                    given = part if given is tops else given.unionByName(part)
                given = given.join(tops, ["site", "c", "path"], "left_semi")
            # from whole paths down to stretches: what comes from above and below each
            ends = [F.lit(0.0).alias("xq"), *[F.lit(1.0).alias(h) for h in _H], F.lit(float("inf")).alias("xh")]
            given = given.select("site", "c", "path", *_Q, *ends)
            names = ["site", "c", "path", "seg", *_Q, "xq", *_H, "xh"]
            for k in range(len(folded) - 1, -1, -1):
                keys = ["site", "c", "path"] if k == len(folded) - 1 else ["site", "c", "path", "group"]
                inner = folded[k].withColumn("group", F.expr(f"seg div {stretch}")).join(given, keys)
                schema = f"site long, c int, path long, seg long, {_doubles([*_Q, 'xq', *_H, 'xh'])}"
                given = self._grouped(inner.drop("group"), [*_KEY[:3], F.expr(f"seg div {stretch}")], lambda t: _scan(step, t, stretch).select(names), schema, n)
                given = store.put(given, "given").withColumnRenamed("seg", "group" if k else "seg")
            inner = rows.join(given, ["site", "c", "path", "seg"] if folded else ["site", "c", "path"])
            out = store.put(self._grouped(inner, _KEY, lambda t: _spread(step, t, stretch), f"site long, c int, kind int, ref long, {_doubles(_A)}", n), "spread")
            found.append(out.where("kind = -1"))
            down = [out] if down is None else [*down, out]
        joint = found[0]
        for part in found[1:]:
            joint = joint.unionByName(part)
        total = sum((F.col(a) for a in _A), F.lit(0.0))
        ll = self._sites(self.by_category)
        share = self.by_category.join(ll, "site").where(F.col("log_likelihood") > float("-inf")).select("site", "c", F.exp(F.col("l") - F.col("log_likelihood")).alias("w"))
        joint = joint.withColumn("total", total).where("total > 0").join(share, ["site", "c"])
        joint = joint.groupBy("site", "ref").agg(*[F.sum(F.col(a) / F.col("total") * F.col("w")).alias(a) for a in _A])
        joint = store.put(joint, "joint")
        nodes = joint.select("site", F.col("ref").alias("node_id"), F.explode(F.array(*[F.struct(F.lit(s).alias("state"), sum((F.col(f"a{i}{s}") for i in range(4)), F.lit(0.0)).alias("p")) for s in range(4)])).alias("e"))
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("parent_state"), F.lit(j).alias("child_state"), F.col(f"a{i}{j}").alias("p")) for i in range(4) for j in range(4)]))
        edges = joint.where(F.col("ref") != self.paths.root).select("site", F.col("ref").alias("child_id"), cells.alias("e"))
        return nodes.select("site", "node_id", "e.state", "e.p"), edges.select("site", "child_id", "e.parent_state", "e.child_state", "e.p")
