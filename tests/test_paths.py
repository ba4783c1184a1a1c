"""Heavy paths and what is worked out along them, against the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeline.functions.models import RateMixture, discrete_gamma, hky, jukes_cantor
from cladeline.functions.trees import Tree
from cladeline.operators import kernels
from cladeline.operators.decompose import distances, heavy_paths
from cladeline.operators.infer import collect_tree
from cladeline.operators.path_pruning import PathPruning
from cladeline.sources.store import Store

MODEL = hky((0.31, 0.19, 0.27, 0.23), 4.2, 0.8)


def trees():
    rng = np.random.default_rng(8)
    chain = np.arange(-1, 199)
    legs = np.r_[np.arange(-1, 59), rng.integers(0, 60, 80)]
    star = np.r_[-1, np.zeros(150, int)]
    bushy = np.array([-1] + [int(rng.integers(max(0, k - 6), k)) for k in range(1, 120)])
    return {"chain": chain, "legs": legs, "star": star, "bushy": bushy, "one": np.array([-1])}


def made(spark, parents, seed=1, sites=6, seen=0.3):
    """(Tree, node rows with scattered ids, observation rows, masks [site, node], id of each node)."""
    rng = np.random.default_rng(seed)
    n = len(parents)
    lengths = np.where(rng.random(n) < 0.1, 0.0, rng.random(n) * 0.3)
    lengths[0] = 0.0
    ids = rng.permutation(10 * n)[:n] + 5
    masks = np.where(rng.random((sites, n)) < seen, rng.choice([1, 2, 4, 8, 3, 14], (sites, n)), 15)
    masks[:, 0] = np.where(masks[:, 0] == 15, 5, masks[:, 0])
    nodes = spark.createDataFrame([(int(ids[v]), int(ids[p]) if p >= 0 else None, float(x)) for v, (p, x) in enumerate(zip(parents, lengths))], "node_id long, parent_id long, branch_length double")
    seen_ = spark.createDataFrame([(s, int(ids[v]), int(masks[s, v])) for s in range(sites) for v in range(n) if masks[s, v] != 15], "site long, node_id long, mask int")
    return Tree(parents, lengths), nodes, seen_, masks, ids


@pytest.mark.parametrize("name", list(trees()))
def test_paths_hold_every_node_once_in_order(spark, name):
    parents = trees()[name]
    tree, nodes, _, _, ids = made(spark, parents)
    with Store(spark, "t") as store:
        cut = heavy_paths(nodes, store, 4)
        rows = {r.node_id: r for r in distances(cut.nodes).collect()}
        assert len(rows) == tree.size and cut.rounds <= 2 * np.log2(tree.size + 1) + 2
        below = np.ones(tree.size, int)
        for v in tree.topological[::-1]:
            if parents[v] >= 0:
                below[parents[v]] += below[v]
        for v in range(tree.size):
            r = rows[ids[v]]
            if parents[v] < 0 or r.pos == 0:
                assert r.path == r.node_id and r.pos == 0 and r.level == int(np.log2(below[v])) and r.x == pytest.approx(tree.lengths[v])
            else:
                up = rows[ids[parents[v]]]
                assert (r.path, r.pos) == (up.path, up.pos + 1) and r.seg >= up.seg and r.x == pytest.approx(up.x + tree.lengths[v])
                siblings = np.flatnonzero(parents == parents[v])
                assert below[v] == below[siblings].max()
        for p in cut.paths.collect():
            if p.t_node is not None:
                assert p.t_level > p.level and (rows[p.t_node].path, rows[p.t_node].pos, rows[p.t_node].level) == (p.t_path, p.t_pos, p.t_level) and p.t_seg >= rows[p.t_node].seg
        assert len(cut.levels) <= np.log2(tree.size) + 1


def test_what_is_no_tree(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "node_id long, parent_id long, branch_length double")
    bad = {
        "one root": make((1, None, 0.0), (2, None, 0.0)),
        "one root ": make(),
        "never reach": make((1, None, 0.0), (2, 3, 0.1), (3, 2, 0.1)),
        "occurs twice": make((1, None, 0.0), (2, 1, 0.1), (2, 1, 0.1)),
        "not in the tree": make((1, None, 0.0), (2, 9, 0.1)),
    }
    for what, nodes in bad.items():
        with Store(spark, "t") as store, pytest.raises(ValueError, match=what.strip()):
            heavy_paths(nodes, store)


@pytest.mark.parametrize(("name", "stretch", "mixture"), [("chain", 4, discrete_gamma(0.7, 2)), ("legs", 3, discrete_gamma(0.5, 3)), ("star", 8, RateMixture()), ("bushy", 2, discrete_gamma(0.7, 2)), ("one", 4, RateMixture())])
def test_likelihoods_and_marginals_are_the_kernels(spark, name, stretch, mixture):
    tree, nodes, seen, masks, ids = made(spark, trees()[name])
    problem = kernels.Problem(tree, MODEL, mixture)
    want = kernels.marginals(problem, masks)
    with Store(spark, "t") as store:
        paths = PathPruning(nodes, seen, MODEL, mixture, store, stretch)
        got = {r.site: r.log_likelihood for r in paths.evaluate().collect()}
        assert sorted(got) == list(range(len(masks)))
        assert np.allclose([got[s] for s in sorted(got)], want["log_likelihood"], rtol=0, atol=1e-9)
        wanted = nodes.crossJoin(spark.range(len(masks)).withColumnRenamed("id", "site")).select("site", "node_id")
        at = {int(x): v for v, x in enumerate(ids)}
        rows = paths.node_marginals(wanted).collect()
        alive = np.isfinite(want["log_likelihood"])
        assert len(rows) == 4 * tree.size * alive.sum()
        assert max(abs(r.p - want["node"][r.site, at[r.node_id], r.state]) for r in rows) < 1e-9
        rows = paths.edge_marginals(wanted.where(F.col("site") < 2)).collect()
        assert len(rows) == 16 * (tree.size - 1) * alive[:2].sum()
        assert not rows or max(abs(r.p - want["edge"][r.site, at[r.child_id], r.parent_state, r.child_state]) for r in rows) < 1e-9


def test_changed_lengths_rework_their_way_up_only(spark):
    tree, nodes, seen, masks, ids = made(spark, trees()["bushy"], sites=4)
    with Store(spark, "t") as store:
        paths = PathPruning(nodes, seen, MODEL, None, store, 4)
        first = sorted(paths.evaluate().collect())
        assert paths.recomputed["nodes"] == tree.size
        leaf = int(tree.leaves[-1])
        change = spark.createDataFrame([(int(ids[leaf]), 0.77)], "node_id long, branch_length double")
        again = sorted(paths.evaluate(change).collect())
        reworked = paths.recomputed["nodes"]
        up, v = set(), leaf
        rows = {r.node_id: r.path for r in paths.paths.nodes.collect()}
        while v >= 0:
            up.add(rows[ids[v]])
            v = tree.parents[v]
        assert reworked == sum(p in up for p in rows.values()) < tree.size and paths.recomputed["paths"] == len(up)
        tree.lengths[leaf] = 0.77
        want = kernels.log_likelihoods(kernels.Problem(tree, MODEL, RateMixture()), masks)
        assert np.allclose([r.log_likelihood for r in again], want, atol=1e-9)
        back = spark.createDataFrame([(int(ids[leaf]), float(nodes.where(F.col("node_id") == int(ids[leaf])).first().branch_length))], "node_id long, branch_length double")
        assert sorted(paths.evaluate(back).collect()) == first and paths.recomputed == {"paths": 0, "nodes": 0}


def test_faults_of_observations(spark):
    nodes = spark.createDataFrame([(1, None, 0.0), (2, 1, 0.1)], "node_id long, parent_id long, branch_length double")
    for rows, what in (([(0, 9, 1)], "not in the tree"), ([(0, 2, 0)], "1 to 15"), ([(0, 2, 16)], "1 to 15")):
        with Store(spark, "t") as store, pytest.raises(Exception, match=what):
            PathPruning(nodes, spark.createDataFrame(rows, "site long, node_id long, mask int"), jukes_cantor(), None, store)


def test_impossible_sites_and_no_observation(spark):
    nodes = spark.createDataFrame([(1, None, 0.0), (2, 1, 0.0), (3, 1, 0.2)], "node_id long, parent_id long, branch_length double")
    seen = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 4)], "site long, node_id long, mask int")
    with Store(spark, "t") as store:
        paths = PathPruning(nodes, seen, jukes_cantor(), None, store)
        got = {r.site: r.log_likelihood for r in paths.evaluate().collect()}
        assert got[0] == float("-inf") and got[1] == pytest.approx(np.log(0.25))
        rows = paths.node_marginals(spark.createDataFrame([(0, 1), (1, 1), (1, 3), (5, 1)], "site long, node_id long")).collect()
        assert {(r.site, r.node_id) for r in rows} == {(1, 1), (1, 3)} and next(r.p for r in rows if r.node_id == 3 and r.state == 2) == 1.0
    with Store(spark, "t") as store:
        assert PathPruning(nodes, seen.limit(0), jukes_cantor(), None, store).evaluate().count() == 0


def test_categories_one_at_a_time_are_all_at_once():
    import tracemalloc

    rng = np.random.default_rng(3)
    parents = np.array([-1] + [int(rng.integers(max(0, k - 6), k)) for k in range(1, 200)])
    tree = Tree(parents, rng.random(200) * 0.2)
    masks = rng.choice([1, 2, 4, 8, 15], (40, 200))
    tree.lengths[0] = 0.0
    masks[0, :2], tree.lengths[1] = (1, 2), 0.0  # a site that cannot occur, if node 1 hangs under the root by no length
    peaks = {}
    for k in (1, 32):
        problem = kernels.Problem(tree, MODEL, discrete_gamma(0.7, k) if k > 1 else RateMixture())
        tracemalloc.start()
        got = kernels.online_marginals(problem, masks)
        peaks[k] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = kernels.marginals(problem, masks)
        assert np.isneginf(got["log_likelihood"][0]) and np.isnan(got["node"][0]).all()
        assert np.allclose(got["log_likelihood"], want["log_likelihood"], atol=1e-9)
        assert np.allclose(got["node"], want["node"], atol=1e-9, equal_nan=True)
        assert np.allclose(got["edge"][:, 1:], want["edge"][:, 1:], atol=1e-9, equal_nan=True)
    assert peaks[32] < 2 * peaks[1]


def test_leaves_of_one_place_are_added_up_before_they_are_sent(spark):
    n, sites = 400, 3
    nodes = spark.createDataFrame([(0, None, 0.0), (1, 0, 0.2), (2, 0, 0.3), *((3 + k, 1 + k % 2, 0.01 * (1 + k % 7)) for k in range(n))], "node_id long, parent_id long, branch_length double")
    tree, ids = collect_tree(nodes)
    masks = np.random.default_rng(4).choice([1, 2, 4, 8, 5, 15], (sites, n + 3))
    masks[:, :3] = 15
    seen = spark.createDataFrame([(s, int(ids[v]), int(masks[s, v])) for s in range(sites) for v in range(3, n + 3)], "site long, node_id long, mask int")
    mixture = discrete_gamma(0.7, 2)
    want = kernels.marginals(kernels.Problem(tree, MODEL, mixture), masks)
    with Store(spark, "t") as store:
        paths = PathPruning(nodes, seen, MODEL, mixture, store)
        got = {r.site: r.log_likelihood for r in paths.evaluate().collect()}
        assert np.allclose([got[s] for s in range(sites)], want["log_likelihood"], atol=1e-9)
        assert sum(t.count() for t in paths.said_tips) <= 2 * 2 * sites
        assert sum(m.count() for level in paths.kept.values() for m in level) <= 2 * 2 * sites  # no message of a leaf is kept
        for some in ([0, 1, 2], [0, 2, 5, 9]):
            asked = [(s, v) for s in range(sites) for v in some]
            rows = paths.node_marginals(spark.createDataFrame(asked, "site long, node_id long")).collect()
            assert len(rows) == 4 * len(asked) and max(abs(r.p - want["node"][r.site, r.node_id, r.state]) for r in rows) < 1e-9
