"""Inference over DataFrames of sites: the tree goes to every task, sites are rows, nothing is shuffled.

A site has ``nodes`` and ``masks``, arrays of the observed nodes and what was seen there; nodes without
an observation are unknown.  Batches are cut so that one array of partial likelihoods stays near
BATCH_BYTES, whatever the tree's size.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.models import NucleotideModel, RateMixture
from ..functions.randomness import GAMMA, scramble, unit
from ..functions.trees import Tree
from . import kernels

BATCH_BYTES = 32 << 20
#: Trees of more nodes do not travel to every task; path_pruning.PathPruning works those out as rows, of any size and depth.
MOST_NODES = 4_000_000


def collect_tree(nodes: DataFrame) -> tuple[Tree, np.ndarray]:
    """nodes (node_id, parent_id, branch_length) -> the tree over 0..n-1 and the node_id of each."""
    rows = nodes.select("node_id", "parent_id", "branch_length").orderBy("node_id").limit(MOST_NODES + 1).toArrow()
    if rows.num_rows > MOST_NODES:
        raise ValueError(f"a tree that goes to every task has at most {MOST_NODES} nodes; see path_pruning.PathPruning")
    ids = rows["node_id"].to_numpy().astype(np.int64)
    known = rows["parent_id"].is_valid().to_numpy().astype(bool)
    parents = np.full(len(ids), -1, np.int64)
    parents[known] = np.searchsorted(ids, rows["parent_id"].drop_null().to_numpy().astype(np.int64))
    return Tree(parents, rows["branch_length"].fill_null(0.0).to_numpy().astype(float)), ids


def dense_masks(pdf: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    """[site, node], 15 where nothing was observed."""
    out = np.full((len(pdf), len(ids)), 15, np.int64)
    counts = pdf["nodes"].map(len).to_numpy()
    if counts.sum():
        nodes, masks = (np.concatenate(pdf[c].to_numpy()).astype(np.int64) for c in ("nodes", "masks"))
        at = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
        if (ids[at] != nodes).any():
            raise ValueError("an observed node is not in the tree")
        out[np.repeat(np.arange(len(pdf)), counts), at] = masks
    return out


class Inference:
    """A tree, a model and a mixture; every method maps a DataFrame of sites to one of results.

    Tree, model and mixture travel to tasks, which work out the transition matrices of a block of edges where they use it.
    """

    def __init__(self, tree: Tree, ids: np.ndarray, model: NucleotideModel, mixture: RateMixture | None = None):
        self.ids = ids
        self.problem = kernels.Problem(tree, model, mixture or RateMixture())

    def _rows(self, categories: int | None = None) -> int:
        return max(1, BATCH_BYTES // (self.problem.tree.size * (categories or self.problem.mixture.count) * 32))

    def _map(self, sites: DataFrame, columns: list[str], schema: str, run, categories: int | None = None) -> DataFrame:
        ids, rows = self.ids, self._rows(categories)

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), rows):
                    part = pdf.iloc[a : a + rows]
                    yield run(part, dense_masks(part, ids))

        return sites.select("site", "nodes", "masks", *columns).mapInPandas(kernel, schema)

    def log_likelihoods(self, sites: DataFrame) -> DataFrame:
        """site, log_likelihood; -Infinity for a site that cannot occur."""
        problem = self.problem
        return self._map(sites, [], "site long, log_likelihood double", lambda pdf, m: pd.DataFrame({"site": pdf["site"], "log_likelihood": kernels.log_likelihoods(problem, m)}))

    def timed_log_likelihoods(self, sites: DataFrame) -> DataFrame:
        """site, log_likelihood, and with the first site of each batch its batches (1) and the seconds of upload (cells to arrays), kernel
        and download (arrays to rows); nulls with the others.  Sums of these, taken while a total is worked out, are its timings."""
        problem, ids, rows = self.problem, self.ids, self._rows()

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), rows):
                    clock = [time.perf_counter()]
                    part = pdf.iloc[a : a + rows]
                    masks = dense_masks(part, ids)
                    clock.append(time.perf_counter())
                    values = kernels.log_likelihoods(problem, masks)
                    clock.append(time.perf_counter())
                    out = pd.DataFrame({"site": part["site"].to_numpy(), "log_likelihood": values})
                    clock.append(time.perf_counter())
                    for name, x in zip(("batches", "upload_s", "kernel_s", "download_s"), (1.0, *np.diff(clock)), strict=True):
                        out[name] = np.r_[x, np.full(len(out) - 1, np.nan)]
                    yield out

        timed = sites.select("site", "nodes", "masks").mapInPandas(kernel, "site long, log_likelihood double, batches double, upload_s double, kernel_s double, download_s double")
        return timed.select("site", "log_likelihood", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("batches", "upload_s", "kernel_s", "download_s")])

    def likelihoods(self, sites: DataFrame) -> DataFrame:
        """site, likelihood, which is 0 where its logarithm is too small."""
        return self.log_likelihoods(sites).select("site", F.exp("log_likelihood").alias("likelihood"))

    def category_posteriors(self, sites: DataFrame) -> DataFrame:
        problem = self.problem

        def run(pdf, m):
            up = kernels.upward(problem, m)
            with np.errstate(invalid="ignore"):
                p = np.exp(up["by_category"] - up["log_likelihood"]).T
            return pd.DataFrame({"site": np.repeat(pdf["site"].to_numpy(), p.shape[1]), "category": np.tile(np.arange(p.shape[1]), len(p)), "p": p.reshape(-1)}).dropna()

        return self._map(sites, [], "site long, category int, p double", run)

    def node_marginals(self, sites: DataFrame, nodes: np.ndarray | None = None, online: bool = False) -> DataFrame:
        """site, node_id, state, p; rows of a site that cannot occur are left out.  ``online`` holds the arrays of one category at a time."""
        problem, ids = self.problem, self.ids
        marginals = kernels.online_marginals if online else kernels.marginals
        keep = np.arange(len(ids)) if nodes is None else np.searchsorted(ids, nodes)

        def run(pdf, m):
            p = marginals(problem, m, keep)["node"]
            s, n, _ = p.shape
            return pd.DataFrame({"site": np.repeat(pdf["site"].to_numpy(), n * 4), "node_id": np.tile(np.repeat(ids[keep], 4), s), "state": np.tile(np.arange(4), s * n), "p": p.reshape(-1)}).dropna()

        return self._map(sites, [], "site long, node_id long, state int, p double", run, 1 if online else None)

    def edge_marginals(self, sites: DataFrame, nodes: np.ndarray | None = None) -> DataFrame:
        """site, child_id, parent_state, child_state, p."""
        problem, ids = self.problem, self.ids
        keep = np.flatnonzero(problem.tree.parents >= 0) if nodes is None else np.searchsorted(ids, nodes)

        def run(pdf, m):
            p = kernels.marginals(problem, m, keep)["edge"]
            s, n = p.shape[:2]
            return pd.DataFrame({"site": np.repeat(pdf["site"].to_numpy(), n * 16), "child_id": np.tile(np.repeat(ids[keep], 16), s), "parent_state": np.tile(np.repeat(np.arange(4), 4), s * n), "child_state": np.tile(np.arange(4), s * n * 4), "p": p.reshape(-1)}).dropna()

        return self._map(sites, [], "site long, child_id long, parent_state int, child_state int, p double", run)

    def joint_maximum(self, sites: DataFrame) -> DataFrame:
        """site, category, log_weight, states (of all nodes in id order; null where the site cannot occur)."""
        problem = self.problem

        def run(pdf, m):
            out = kernels.joint_maximum(problem, m)
            states = [None if c < 0 else s for s, c in zip(out["states"].tolist(), out["category"], strict=True)]
            category = pd.Series(out["category"], dtype="Int64").mask(out["category"] < 0)
            return pd.DataFrame({"site": pdf["site"].to_numpy(), "category": category, "log_weight": out["log_weight"], "states": states})

        return self._map(sites, [], "site long, category long, log_weight double, states array<long>", run)

    def map_weights(self, sites: DataFrame) -> DataFrame:
        """site, log_weight: the weight of the joint maximum, added up again edge by edge."""
        problem = self.problem

        def run(pdf, m):
            out = kernels.joint_maximum(problem, m)
            return pd.DataFrame({"site": pdf["site"].to_numpy(), "log_weight": kernels.assignment_log_weight(problem, out["states"], out["category"])})

        return self._map(sites, [], "site long, log_weight double", run)

    def samples(self, sites: DataFrame, seed: int | None = None, uniform: float | None = None, nodes: np.ndarray | None = None) -> DataFrame:
        """site, category, states (of all nodes in id order, or of ``nodes``) drawn from the posterior.

        The draws are a hash of seed, site and node, so a site's sample does not depend on how sites are
        partitioned; or all ``uniform``.
        """
        problem, n = self.problem, len(self.ids)
        keep = None if nodes is None else np.searchsorted(self.ids, nodes)

        def run(pdf, m):
            if uniform is not None:
                u = np.full((len(pdf), n + 1), uniform)
            else:
                at = pdf["site"].to_numpy(np.int64).view(np.uint64)[:, None] * np.uint64(n + 1) + np.arange(n + 1, dtype=np.uint64)
                u = unit(scramble((at ^ np.uint64(seed or 0)) + np.uint64(GAMMA)))
            out = kernels.posterior_sample(problem, m, u[:, :n], u[:, n], keep)
            return pd.DataFrame({"site": pdf["site"].to_numpy(), "category": out["category"], "states": out["states"].tolist()})

        return self._map(sites, [], "site long, category long, states array<long>", run)


class Resident:
    """A problem that is evaluated again and again, and what is worked out anew before each time.

    full-input-update: sites and factors; factor-update: factors only, over sites that are kept as a written table;
    fixed-model: neither.  ``timings`` has, by evaluation, the seconds of preparing, of running, and of both (wall), and what the tasks
    observed while the total was worked out: batches, and the seconds of upload, kernel and download, summed over tasks.
    """

    def __init__(self, tree: Tree, ids: np.ndarray, sites: DataFrame, folder: str):
        self.tree, self.ids, self.source, self.folder = tree, ids, sites, folder
        self.kept: DataFrame | None = None
        self.inference: Inference | None = None
        self.turn = 0
        self.timings: list[dict[str, float]] = []

    def evaluate(self, mode: str, model: NucleotideModel | None = None, mixture: RateMixture | None = None) -> float:
        """The sum of the log-likelihoods of all sites."""
        if mode not in ("full-input-update", "factor-update", "fixed-model"):
            raise ValueError(f"no mode {mode}")
        if mode != "full-input-update" and self.kept is None or mode == "fixed-model" and self.inference is None:
            raise ValueError(f"{mode} needs an evaluation before it")
        began = time.perf_counter()
        if mode == "full-input-update":
            path, self.turn = f"{self.folder}/sites-{self.turn}", self.turn + 1
            self.source.write.parquet(path)
            self.kept = self.source.sparkSession.read.parquet(path)
        if mode != "fixed-model":
            if model is None:
                raise ValueError(f"{mode} needs a model")
            self.inference = Inference(self.tree, self.ids, model, mixture)
        ready = time.perf_counter()
        seen = Observation()
        parts = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("upload_s", "kernel_s", "download_s", "batches")]
        total = self.inference.timed_log_likelihoods(self.kept).observe(seen, *parts).agg(F.sum("log_likelihood")).first()[0]
        ended = time.perf_counter()
        self.timings.append({"prepare_s": ready - began, "run_s": ended - ready, "wall_s": ended - began} | seen.get)
        return total


def weighted_total(scored: DataFrame) -> DataFrame:
    """scored (log_likelihood, weight) -> n_patterns, n_sites, total."""
    return scored.agg(F.count("*").alias("n_patterns"), F.sum("weight").alias("n_sites"), F.sum(F.col("weight") * F.col("log_likelihood")).alias("total"))
