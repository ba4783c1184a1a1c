"""Models, trees, kernels, parsers and generators, without Spark where it is not needed."""

import itertools
import math

import numpy as np
import pytest

from cladeline.functions import generate, models, randomness
from cladeline.functions.models import NucleotideModel, RateMixture, discrete_gamma, gtr, hky, jukes_cantor
from cladeline.functions.trees import Tree, floor_lengths
from cladeline.operators import kernels
from cladeline.sources import text as parse

MASK = {c: k for k, c in enumerate(parse.MASK_CODES) if k} | {c: 15 for c in parse.UNKNOWN}
PI = (0.31, 0.19, 0.27, 0.23)
RAGGED = Tree([-1, 0, 0, 1, 1, 3, 2], [0, 0.1, 0.3, 0.2, 0.4, 0.15, 0.5])
CONFORMANCE = gtr((0.3, 0.2, 0.2, 0.3), (1.2, 3.1, 0.7, 1.8, 4.6, 0.9))


def masks(columns, nodes, size):
    out = np.full((len(columns), size), 15)
    for k, column in enumerate(columns):
        out[k, list(nodes)] = [MASK[c] for c in column]
    return out


SITES = masks(["RGT", "CCA", "NYB", "VWD", "HMS"], (4, 5, 6), 7)


# --- models


def test_discrete_gamma():
    got = discrete_gamma(0.5, 4)
    np.testing.assert_allclose(got.rates, [0.0333877533835995, 0.251915917593438, 0.820268481973650, 2.89442784704931], atol=2e-7)
    for shape in (0.05, 1, 20):
        rates = np.array(discrete_gamma(shape, 8).rates)
        assert (rates > 0).all() and abs(rates.mean() - 1) < 1e-12


@pytest.mark.parametrize("model", [jukes_cantor(1.7), hky(PI, 4.2, 0.8), gtr(PI, (1.2, 3.1, 0.7, 1.8, 4.6, 0.9), 1.3)])
def test_transitions(model):
    pi = np.array(model.pi)
    p = models.transitions(model, np.array([0, 1e-12, 1e-5, 0.2, 10, 0.17, 0.29, 0.46]))
    assert (p[0] == np.eye(4)).all() and (p >= 0).all()
    np.testing.assert_allclose(p.sum(axis=2), 1, atol=1e-14)
    np.testing.assert_allclose(pi[:, None] * p, (pi[:, None] * p).swapaxes(1, 2), atol=1e-14)
    np.testing.assert_allclose(p[5] @ p[6], p[7], atol=1e-13)
    np.testing.assert_allclose(pi @ p[3], pi, atol=1e-14)
    form = models.spectral_form(model)
    np.testing.assert_allclose(np.einsum("k,kab->ab", np.exp(form.lam * 0.2), form.coef), p[3], atol=1e-13)


def test_jukes_cantor_closed_form():
    p = models.jukes_cantor_transition(0.23, 1.7)
    assert abs(p[0, 1] + 0.25 * math.expm1(-4 * 1.7 * 0.23 / 3)) < 1e-15


@pytest.mark.parametrize(
    "make",
    [
        lambda: gtr((0.0, 0.4, 0.3, 0.3), (1,) * 6),
        lambda: gtr((0.3, 0.3, 0.3, 0.3), (1,) * 6),
        lambda: RateMixture((1.0, 2.0), (0.5, 0.6)),
        lambda: RateMixture((0.0, 2.0), (0.5, 0.5)),
        lambda: RateMixture((1.0,), ()),
        lambda: hky(PI, -1.0),
        lambda: models.transitions(jukes_cantor(1e300), np.array([1e300])),
        lambda: models.transitions(jukes_cantor(), np.array([-1.0])),
        lambda: models.rate_matrix(NucleotideModel(PI, (0.0,) * 6)),
        lambda: discrete_gamma(0.0, 4),
    ],
)
def test_rejected(make):
    with pytest.raises(ValueError):
        make()


def test_categories():
    mix = discrete_gamma(0.7, 4)
    assert RateMixture().count == 1 and RateMixture().rate(0) == RateMixture().weight(0) == 1.0
    assert models.select_category(jukes_cantor(2.0), mix, 1).rate == 2.0 * mix.rates[1]
    with pytest.raises(IndexError):
        mix.rate(4)


# --- likelihood


def brute(problem, row):
    """Total, node marginals and the best assignment over all states and categories of one site."""
    tree = problem.tree
    total, node, category, best = 0.0, np.zeros((tree.size, 4)), np.zeros(problem.mixture.count), (-1.0, None, None)
    for c in range(problem.mixture.count):
        for states in itertools.product(range(4), repeat=tree.size):
            if any(not row[v] >> s & 1 for v, s in enumerate(states)):
                continue
            w = problem.mixture.weight(c) * problem.model.root[states[tree.root]]
            for v in range(tree.size):
                if tree.parents[v] >= 0:
                    w *= problem.p[v, c, states[tree.parents[v]], states[v]]
            total += w
            category[c] += w
            for v, s in enumerate(states):
                node[v, s] += w
            if w > best[0]:
                best = (w, c, states)
    return total, node / total, category / total, best


@pytest.mark.parametrize("mixture", [RateMixture(), discrete_gamma(0.7, 3)])
def test_kernels_are_brute_force(mixture):
    problem = kernels.Problem(Tree([-1, 0, 0, 1, 1], [0, 0.1, 0.2, 0.3, 0.05]), hky(PI, 4, 0.8), mixture)
    rows = masks(["AGT", "RYN", "CCA", "WSK"], (2, 3, 4), 5)
    rows[3, 0] = 5  # an observed root
    ll, m, joint = kernels.log_likelihoods(problem, rows), kernels.marginals(problem, rows), kernels.joint_maximum(problem, rows)
    for k, row in enumerate(rows):
        total, node, category, (w, c, states) = brute(problem, row)
        assert abs(ll[k] - math.log(total)) < 1e-12
        np.testing.assert_allclose(m["node"][k], node, atol=1e-12)
        np.testing.assert_allclose(m["category"][k], category, atol=1e-12)
        np.testing.assert_allclose(m["edge"][k, 1:].sum(axis=2), node[problem.tree.parents[1:]], atol=1e-12)
        np.testing.assert_allclose(m["edge"][k, 1:].sum(axis=1), node[1:], atol=1e-12)
        assert tuple(joint["states"][k]) == states and joint["category"][k] == c and abs(joint["log_weight"][k] - math.log(w)) < 1e-12
    np.testing.assert_allclose(kernels.assignment_log_weight(problem, joint["states"], joint["category"]), joint["log_weight"], atol=1e-12)


# Results that are published or agreed on.
def test_conformance_goldens():
    one, four = kernels.Problem(RAGGED, CONFORMANCE, RateMixture()), kernels.Problem(RAGGED, CONFORMANCE, discrete_gamma(0.7, 4))
    np.testing.assert_allclose(kernels.log_likelihoods(one, SITES), [-3.830602714362235, -4.338844121823586, -0.8753978468642998, -1.1114799554067978, -1.8469937476819682], rtol=1e-11)
    np.testing.assert_allclose(kernels.log_likelihoods(four, SITES), [-4.131614953131807, -4.649732672155003, -0.8314990073221952, -1.1379923983800295, -1.7820991], rtol=1e-7)
    best = kernels.joint_maximum(one, SITES)
    assert ["".join("ACGT"[s] for s in row) for row in best["states"]] == ["GGGGGGT", "CCCCCCA", "TTTTTTT", "AAAAAAA", "CCCCCCC"]


def test_external_goldens():
    nodes = parse.parse_newick("((A:0.1,B:0.2):0.3,(C:0.4,D:0.5):0.6);")
    tree = Tree([-1 if p is None else p for _, p, _, _ in nodes], [x for *_, x in nodes])
    records = parse.parse_phylip("4 12\nA ACRYSWKMBDHV\nB AAAAAAAAAAAA\nC TTTTTTTTTTTT\nD CCCCCCCCCCCC")
    at = {label: k for k, _, label, _ in nodes if label}
    rows = masks(list(zip(*(s for _, _, s in records))), [at[n] for _, n, _ in records], tree.size)
    want = [-5.040094590240, -6.981834284265, -4.934072093490, -6.251378523747, -6.405406411110, -4.896548084956, -6.363574230408, -4.906040938581, -5.932518541162, -4.804068470622, -4.779412771342, -4.812719161660]
    np.testing.assert_allclose(kernels.log_likelihoods(kernels.Problem(tree, jukes_cantor(), RateMixture()), rows), want, rtol=1e-11)


def test_impossible_sites_and_zero_lengths():
    problem = kernels.Problem(Tree([-1, 0, 0], [0, 0, 0]), jukes_cantor(), RateMixture())
    rows = masks(["AC", "AA"], (1, 2), 3)
    assert kernels.log_likelihoods(problem, rows).tolist() == [-math.inf, math.log(0.25)]
    joint, sample = kernels.joint_maximum(problem, rows), kernels.posterior_sample(problem, rows, np.full((2, 3), 0.5))
    assert joint["category"].tolist() == [-1, 0] and joint["states"].tolist() == [[-1] * 3, [0] * 3]
    assert sample["states"].tolist() == [[-1] * 3, [0] * 3]
    m = kernels.marginals(problem, rows)
    assert np.isnan(m["node"][0]).any() and m["node"][1].tolist() == [[1, 0, 0, 0]] * 3
    with pytest.raises(ValueError):
        kernels.log_likelihoods(problem, np.array([[0, 1, 1]]))


def test_wide_and_deep_trees_do_not_underflow():
    n = 4_000
    wide = kernels.Problem(Tree([-1] + [0] * n, np.full(n + 1, 0.1)), jukes_cantor(), RateMixture())
    deep = kernels.Problem(Tree([-1, 0, 0, *(v for k in range(2, n, 2) for v in (k, k))][: n + 1], np.full(n + 1, 0.1)), jukes_cantor(), RateMixture())
    for problem in (wide, deep):
        rows = np.full((1, n + 1), 15)
        rows[0, problem.tree.leaves] = 1 << np.arange(len(problem.tree.leaves)) % 4
        assert -1e5 < kernels.log_likelihoods(problem, rows)[0] < -100


def test_samples_follow_the_posterior():
    problem = kernels.Problem(RAGGED, CONFORMANCE, discrete_gamma(0.7, 4))
    rows = np.repeat(SITES[:1], 20_000, axis=0)
    rng = np.random.default_rng(1)
    got = kernels.posterior_sample(problem, rows, rng.random((20_000, 7)), rng.random(20_000))
    want = kernels.marginals(problem, SITES[:1])
    for v in range(7):
        np.testing.assert_allclose(np.bincount(got["states"][:, v], minlength=4) / 20_000, want["node"][0, v], atol=0.02)
    np.testing.assert_allclose(np.bincount(got["category"], minlength=4) / 20_000, want["category"][0], atol=0.02)
    with pytest.raises(ValueError):
        kernels.posterior_sample(problem, rows[:1], np.full((1, 7), 1.0))


# --- generators


# Fingerprints of simulated alignments.
@pytest.mark.parametrize("kind, fingerprint", [("yule", 2641326333024873219), ("beta-critical", 10536925141760390345), ("uniform", 10735218043514194703), ("caterpillar", 5234058107032935918)])
def test_simulation_fingerprints(kind, fingerprint):
    parents = generate.topology(kind, 32, 71)
    tree = Tree(parents, np.zeros(len(parents)))
    tree = Tree(parents, tree.clock_like(0.1))
    np.testing.assert_allclose(tree.root_to_tip()[tree.leaves], 0.1, atol=2e-7)
    assert randomness.fnv1a(generate.simulate_jukes_cantor(tree, 64, 8128).tobytes()) == fingerprint


@pytest.mark.parametrize("kind", generate.TOPOLOGIES)
def test_topologies(kind):
    parents = generate.topology(kind, 64, 7)
    tree = Tree(parents, np.zeros(127))
    assert len(parents) == 127 and len(tree.leaves) == 64 and (parents == generate.topology(kind, 64, 7)).all()
    shape = tree.shape()
    assert shape["binary"]
    if kind == "balanced":
        assert shape["height"] == 6 and shape["colless"] == 0
    if kind == "caterpillar":
        assert shape["height"] == 63 and shape["normalized_colless"] == 1


def test_stream_is_the_counter_form():
    s = randomness.Stream(99, ahead=3)
    assert [s.next() for _ in range(10)] == randomness.stream(99, 10).tolist() == [*randomness.stream(99, 4).tolist(), *randomness.stream(99, 6, 4).tolist()]
    assert all(randomness.Stream(k).below(3) < 3 for k in range(50))
    seeds = {randomness.case_seed(1, 32, 8, r, t) for r in range(5) for t in ("yule", "uniform")} | {randomness.topology_seed(1, 32, r, "yule") for r in range(5)}
    assert len(seeds) == 15 and randomness.sequence_seed(5, 10, 0.1) != randomness.sequence_seed(5, 10, 0.2)


def test_unique_patterns(spark):
    rows = generate.unique_patterns(spark, 257, 8, 3).collect()
    assert len({bytes(r.masks) for r in rows}) == 257 and {b for r in rows for b in r.masks} <= {1, 2, 4, 8}
    with pytest.raises(ValueError):
        generate.unique_patterns(spark, 17, 2, 3)


@pytest.mark.parametrize("parts", [0, 1, 5, 64, 65, 200])
def test_more_columns_than_the_leaves_can_spell(spark, tmp_path, parts):
    import duckdb

    from cladeline.plans import tables

    spark.range(parts).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM range({parts}) t(p_partkey)")
    got = {(r.site, r.masks) for r in tables._drawn(spark, str(tmp_path), 3).collect()}
    assert got == set(con.sql(tables._patterns_sql(3)).fetchall()) and len(got) == parts


def test_floor_lengths():
    got, raised = floor_lengths([0.0, 0.5, 1e-9], 1e-6)
    assert got.tolist() == [1e-6, 0.5, 1e-6] and raised == 2


# --- parsers


def test_newick():
    got = parse.parse_newick("((A:0.1,'B_taxon':0.2)I:0.3,C:0.4)Root;")
    assert [(n, p, label) for n, p, label, _ in got] == [(0, None, "Root"), (1, 0, "I"), (2, 1, "A"), (3, 1, "B_taxon"), (4, 0, "C")]
    assert [x for *_, x in got][1:] == [0.3, 0.1, 0.2, 0.4]
    assert parse.parse_newick(" [a [nested] comment] ( 'it''s' : 1e-3 , b [x] ) ; [end]")[1][2:] == ("it's", 0.001)
    assert parse.parse_newick(parse.write_newick(got)) == got
    deep = "(" * 50_000 + "a" + ",b)" * 50_000 + ";"
    assert len(parse.parse_newick(deep)) == 100_001


@pytest.mark.parametrize("text", ["(A,B)", "(A,,B);", "(A,B);x", "(A:-1,B);", "(A:x,B);", "(A,B));", "[open (A,B);", "('open,B);", "", "(A:inf,B);", "(A,());"])
def test_newick_rejects(text):
    with pytest.raises(parse.ParseError):
        parse.parse_newick(text)


def test_fasta_and_phylip():
    got = parse.parse_fasta(">A description\nRY\nSW\n>B_taxon\nkm bd\n>C\nHVN-\n")
    assert got == [(0, "A", "RYSW"), (1, "B_taxon", "KMBD"), (2, "C", "HVN-")]
    assert parse.parse_fasta(">A\nACGU\n>B\nUUUU\n", rna=True)[1][2] == "TTTT"
    assert parse.parse_phylip("3 3\nA ACG\nB A-G\nC TTT\n")[1] == (1, "B", "A-G")
    assert [s for *_, s in parse.parse_phylip("3 9\nA ACG\nB CGT\nC GTA\n\nTTT\nAAA\nCCC\n\nGGG\nTTT\nAAA\n")] == ["ACGTTTGGG", "CGTAAATTT", "GTACCCAAA"]
    assert [s for *_, s in parse.parse_phylip("3 6\nA ACG\nB CGT\nC GTA\nA TTT\nB AAA\nC CCC\n")] == ["ACGTTT", "CGTAAA", "GTACCC"]


@pytest.mark.parametrize("text", ["ACGT\n", ">\nACGT\n", ">A\nAC\n>A\nAC\n", ">A\nAC\n>B\nACG\n", ">A\nAZ!\n", "", ">A\n"])
def test_fasta_rejects(text):
    with pytest.raises(parse.ParseError):
        parse.parse_fasta(text)


@pytest.mark.parametrize("text", ["", "2\nA AC\nB AC", "2 2 x\nA AC\nB AC", "0 2\n", "2 3\nA AC\nB AC\n", "2 2\nA AC\n", "2 2\nA ACG\nB ACG\n"])
def test_phylip_rejects(text):
    with pytest.raises(parse.ParseError):
        parse.parse_phylip(text)


def test_pandit():
    got = parse.parse_pandit("FAM PF1\nDPH (A:1,\nDPH B:2);\nDMK x.x\nNAM A\nDSQ ACG\nNAM B\nDSQ A-G\n//\nFAM PF2\n//\n")
    assert [f["family"] for f in got] == ["PF1", "PF2"] and got[0]["tree"] == "(A:1,B:2);"
    assert [parse.masked(s, got[0]["mask"]) for _, s in got[0]["sequences"]] == ["AG", "AG"]


def test_sources_in_spark(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((A:0.1,B:0.2)I:0.3,C:0.4)R;")
    (tmp_path / "s.fasta").write_text("".join(f">n{k} x\n{'ACGT' * 5}\n{'AC' * 3}\n" for k in range(200)))
    parse.register(spark)
    tree = spark.read.format("newick").load(str(tmp_path / "t.nwk"))
    assert tree.count() == 5 and tree.where("parent_id IS NULL").count() == 1
    assert parse.newick_nodes(parse.read_whole(spark, str(tmp_path / "t.nwk"))).count() == 5
    records = spark.read.format("fasta").option("path", str(tmp_path / "s.fasta")).option("bytes_per_partition", "700").load()
    rows = records.collect()
    assert len(rows) == 200 and len({r.name for r in rows}) == 200 and {r.sequence for r in rows} == {"ACGT" * 5 + "AC" * 3}
    assert records.rdd.getNumPartitions() > 5
    wrapped = parse.wrap_fasta(spark.createDataFrame([("a", "A" * 160), ("b", "C" * 81)], "name string, sequence string")).collect()
    assert [r.value for r in wrapped] == [">a\n" + "A" * 80 + "\n" + "A" * 80, ">b\n" + "C" * 80 + "\nC"]


def test_what_travels_is_the_tree_and_not_its_matrices():
    import pickle

    n = 20_000
    tree = Tree(np.r_[-1, np.zeros(n, np.int64)], np.r_[0.0, np.linspace(0.01, 0.2, n)])
    problem = kernels.Problem(tree, CONFORMANCE, discrete_gamma(0.7, 64))
    assert len(pickle.dumps(problem)) < 100 * n  # 64 matrices of a node are 8192 bytes


@pytest.mark.parametrize("few", [False, True])
def test_blocks_of_edges_give_what_all_at_once_gives(monkeypatch, few):
    rng = np.random.default_rng(5)
    parents = np.array([-1] + [int(rng.integers(max(0, k - 9), k)) for k in range(1, 120)])
    tree = Tree(parents, np.r_[0.0, rng.choice([0.0, 0.1, 0.2], 119) if few else rng.random(119) * 0.2])
    problem = kernels.Problem(tree, CONFORMANCE, discrete_gamma(0.7, 3))
    masks = rng.choice([1, 2, 4, 8, 5, 15, 15], (7, 120))
    masks[:, tree.heights > 0] = 15
    u, c = rng.random((7, 120)), rng.random(7)
    nodes = np.array([17, 0, 3, 119, 60])
    runs = []
    for held, cells in ((1 << 30, 1 << 40), (0, 40)):
        monkeypatch.setattr(kernels, "HELD_BYTES", held)
        monkeypatch.setattr(kernels, "BLOCK_CELLS", cells)
        whole, part = kernels.marginals(problem, masks), kernels.marginals(problem, masks, nodes)
        drawn, some = kernels.posterior_sample(problem, masks, u, c), kernels.posterior_sample(problem, masks, u, c, nodes)
        best = kernels.joint_maximum(problem, masks)
        assert np.allclose(whole["node"][:, nodes], part["node"], equal_nan=True) and np.allclose(whole["edge"][:, nodes], part["edge"], equal_nan=True)
        assert (drawn["states"][:, nodes] == some["states"]).all()
        np.testing.assert_allclose(kernels.assignment_log_weight(problem, best["states"], best["category"]), best["log_weight"])
        runs.append([whole["node"], whole["edge"], whole["log_likelihood"], drawn["states"], best["states"], best["log_weight"]])
    for a, b in zip(*runs, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


def test_samples_of_a_wide_tree_hold_no_matrices_of_all_edges():
    import tracemalloc

    n = 100_000
    tracemalloc.start()
    problem = kernels.Problem(Tree(np.r_[-1, np.zeros(n, np.int64)], np.r_[0.0, np.linspace(0.01, 0.2, n)]), CONFORMANCE, discrete_gamma(0.7, 4))
    masks, u = np.full((1, n + 1), 2), np.full((1, n + 2), 0.5)
    got = kernels.posterior_sample(problem, masks, u[:, :-1], u[:, -1], np.array([0, 7]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["states"].tolist() == [[1, 1]] and peak < 1000 * n  # the matrices are 512 bytes a node, and were held twice and copied
