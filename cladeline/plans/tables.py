"""Queries over models, generators and refusals whose inputs are rows of the tables: their work grows with them.

Numbers in the SQL stand as literals or follow from closed forms, and wanted texts are listed apart from what the queries run on.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import generate, models, randomness
from ..functions.models import NucleotideModel, RateMixture, discrete_gamma, gtr, hky, jukes_cantor
from ..functions.trees import Tree
from ..operators import report, runs
from ..sources import text as sources
from .catalog import GTR, HKY, _small, query
from .derive import read


def _mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """One frame for each batch of rows, by make(frame)."""

    def run(batches):
        for pdf in batches:
            yield make(pdf)

    return rows.mapInPandas(run, schema)


def _cells(keys: np.ndarray, matrices: np.ndarray, name: str) -> pd.DataFrame:
    n = len(keys)
    return pd.DataFrame({name: np.repeat(keys, 16), "parent_state": np.tile(np.repeat(np.arange(4), 4), n), "child_state": np.tile(np.arange(4), 4 * n), "p": np.round(matrices.reshape(-1), 9)})


# --- transitions and rates

_CELL = "parent_state int, child_state int, p double"


@query("SELECT CAST(s_suppkey AS BIGINT) AS supplier, round(0.25 - 0.25 * exp(-4 * 1.7 * t / 3), 9) AS differs, round(0.25 + 0.75 * exp(-4 * 1.7 * t / 3), 9) AS same FROM (SELECT s_suppkey, 0.013 * (s_suppkey % 997) AS t FROM supplier)")
def jc69_transition(spark, d):
    def make(pdf):
        p = models.transitions(jukes_cantor(1.7), 0.013 * (pdf["s_suppkey"].to_numpy() % 997))
        return pd.DataFrame({"supplier": pdf["s_suppkey"], "differs": np.round(p[:, 0, 1], 9), "same": np.round(p[:, 0, 0], 9)})

    return _mapped(read(spark, d, "supplier").select("s_suppkey"), "supplier long, differs double, same double", make)


@query("""WITH s(a, pi, grp) AS (VALUES (0, 0.31::DOUBLE, 0.58::DOUBLE), (1, 0.19::DOUBLE, 0.42::DOUBLE), (2, 0.27::DOUBLE, 0.58::DOUBLE), (3, 0.23::DOUBLE, 0.42::DOUBLE)),
t AS (SELECT s_suppkey, 0.8 * 0.003 * (s_suppkey % 500) / (2 * 0.58 * 0.42 + 2 * 4.2 * (0.31 * 0.27 + 0.19 * 0.23)) AS bt FROM supplier)
SELECT CAST(s_suppkey AS BIGINT) AS supplier, x.a AS parent_state, y.a AS child_state, round(CASE WHEN x.a = y.a THEN y.pi + y.pi * (1 / y.grp - 1) * exp(-bt) + (y.grp - y.pi) / y.grp * exp(-bt * (1 + y.grp * 3.2))
WHEN x.a % 2 = y.a % 2 THEN y.pi + y.pi * (1 / y.grp - 1) * exp(-bt) - y.pi / y.grp * exp(-bt * (1 + y.grp * 3.2)) ELSE y.pi * (1 - exp(-bt)) END, 9) AS p FROM t, s x, s y""")
def hky_transition(spark, d):
    make = lambda pdf: _cells(pdf["s_suppkey"].to_numpy(), models.transitions(HKY, 0.003 * (pdf["s_suppkey"].to_numpy() % 500)), "supplier")
    return _mapped(read(spark, d, "supplier").select("s_suppkey"), f"supplier long, {_CELL}", make)


# Eigenvalues of the rate matrix, and of each the 4 x 4 coefficients, rows by parent state.
_GTR_FORM = """(VALUES (-1.827656116610649::DOUBLE, [[0.001354284665402, 0.023238765953086, -0.007067343458347, -0.017525707160141], [0.037915881291877, 0.650615275913994, -0.197864276589134, -0.490666880616736], [-0.008114357304028, -0.139237824266428, 0.042344827107877, 0.105007354462579], [-0.023621605302799, -0.405333510074695, 0.123269503064767, 0.305685612312727]]::DOUBLE[][]),
(-1.55680698047976, [[0.409154877475673, -0.054188829846574, -0.44394484502127, 0.08897879739217], [-0.088413353960199, 0.011709541930608, 0.095931039521838, -0.019227227492246], [-0.509714451691087, 0.067507027811664, 0.553054883904092, -0.110847460024668], [0.119927944311187, -0.015883361841421, -0.130125279159393, 0.026080696689627]]),
(-0.719415911835835, [[0.279490837858924, -0.159049936106512, 0.181012188479617, -0.301453090232029], [-0.259502527331677, 0.147675182155398, -0.168066762932703, 0.279894108108982], [0.207828808995116, -0.118269203545236, 0.134600288988031, -0.224159894437911], [-0.406306339008388, 0.231216871916116, -0.263144223905374, 0.438233690997646]]),
(0, [[0.31, 0.19, 0.27, 0.23], [0.31, 0.19, 0.27, 0.23], [0.31, 0.19, 0.27, 0.23], [0.31, 0.19, 0.27, 0.23]]))"""


@query(f"SELECT CAST(s_suppkey AS BIGINT) AS supplier, CAST(a AS INTEGER) AS parent_state, CAST(b AS INTEGER) AS child_state, round(sum(f[a + 1][b + 1] * exp(lam * 1.3 * 0.002 * (s_suppkey % 500))), 9) AS p FROM supplier, {_GTR_FORM} v(lam, f), range(4) x(a), range(4) y(b) GROUP BY 1, 2, 3")
def gtr_transition(spark, d):
    make = lambda pdf: _cells(pdf["s_suppkey"].to_numpy(), models.transitions(GTR, 0.002 * (pdf["s_suppkey"].to_numpy() % 500)), "supplier")
    return _mapped(read(spark, d, "supplier").select("s_suppkey"), f"supplier long, {_CELL}", make)


_MATRIX_SQL = """off AS (SELECT k, i AS a, j AS b, e.x * pi.x AS q FROM e JOIN pi USING (k) WHERE pi.s = e.j UNION ALL SELECT k, j, i, e.x * pi.x FROM e JOIN pi USING (k) WHERE pi.s = e.i),
flow AS (SELECT k, sum(pi.x * q) AS f FROM off JOIN pi USING (k) WHERE pi.s = a GROUP BY 1)
SELECT CAST(k AS BIGINT) AS nation, CAST(a AS INTEGER) AS parent_state, CAST(b AS INTEGER) AS child_state, round(q / f, 9) AS p FROM off JOIN flow USING (k) UNION ALL SELECT k, a, a, round(-sum(q) / max(f), 9) FROM off JOIN flow USING (k) GROUP BY 1, 2"""


@query(f"""WITH pi AS (SELECT n_nationkey AS k, s, CAST(1 + (n_nationkey + s) % 4 AS DOUBLE) / 10 AS x FROM nation, range(4) r(s)),
e AS (SELECT n_nationkey AS k, i, j, CAST(1 + (n_nationkey * (o + 1)) % 7 AS DOUBLE) AS x FROM nation, (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)) v(o, i, j)), {_MATRIX_SQL}""")
def gtr_rate_matrix(spark, d):
    """A model for each nation."""

    def make(pdf):
        k = pdf["n_nationkey"].to_numpy()
        matrices = [models.rate_matrix(gtr(tuple((1 + (n + s) % 4) / 10 for s in range(4)), tuple(1.0 + (n * (o + 1)) % 7 for o in range(6)), 1.3)) for n in k.tolist()]
        return _cells(k, np.stack(matrices), "nation") if matrices else _cells(k, np.zeros((0, 4, 4)), "nation")

    return _mapped(read(spark, d, "nation").select("n_nationkey"), f"nation long, {_CELL}", make)


@query(f"""WITH pi AS (SELECT n_nationkey AS k, s, x FROM nation, (VALUES (0, 0.3::DOUBLE), (1, 0.2::DOUBLE), (2, 0.2::DOUBLE), (3, 0.3::DOUBLE)) v(s, x)),
e AS (SELECT n_nationkey AS k, i, j, CASE WHEN n_nationkey % 2 = 0 THEN g WHEN (i, j) IN ((0, 2), (1, 3)) THEN 1 + n_nationkey / 4 ELSE 1 END AS x FROM nation, (VALUES (0, 1, 1.2::DOUBLE), (0, 2, 3.1::DOUBLE), (0, 3, 0.7::DOUBLE), (1, 2, 1.8::DOUBLE), (1, 3, 4.6::DOUBLE), (2, 3, 0.9::DOUBLE)) v(i, j, g)), {_MATRIX_SQL}""")
def preset_rate_matrices(spark, d):
    """The presets as command lines name them: gtr for even nations, hky of the nation's kappa for odd ones."""

    def make(pdf):
        k = pdf["n_nationkey"].to_numpy()
        words = [["--substitution-model=gtr"] if n % 2 == 0 else ["--substitution-model", "hky", "--hky-kappa", str(1 + n / 4)] for n in k.tolist()]
        return _cells(k, np.stack([models.rate_matrix(runs.parse_options(w).evolution()[0]) for w in words]), "nation")

    return _mapped(read(spark, d, "nation").select("n_nationkey"), f"nation long, {_CELL}", make)


#: Of a gamma variable of shape 1 and of k slices of equal weight, the mean of slice i: closed, as the variable is exponential.
_SLICE = "k * ((1 - ln(1 - i / k)) * (1 - i / k) - CASE WHEN i + 1 = k THEN 0 ELSE (1 - ln(1 - (i + 1) / k)) * (1 - (i + 1) / k) END)"
_SLICES = f"SELECT CAST(n AS BIGINT) AS nation, CAST(i AS INTEGER) AS category, {{rate}} AS rate, round(1 / k, 12) AS weight FROM (SELECT n_nationkey AS n, CAST(i AS DOUBLE) AS i, CAST(2 + n_nationkey AS DOUBLE) AS k FROM nation, range(40) r(i) WHERE i < 2 + n_nationkey)"


def _categories(spark, d, rate) -> DataFrame:
    def make(pdf):
        rows = [(n, c, round(rate(m, c), 9), round(m.weight(c), 12)) for n in pdf["n_nationkey"].tolist() for m in [discrete_gamma(1.0, 2 + n)] for c in range(m.count)]
        return pd.DataFrame(rows, columns=["nation", "category", "rate", "weight"])

    return _mapped(read(spark, d, "nation").select("n_nationkey"), "nation long, category int, rate double, weight double", make)


@query(_SLICES.replace("{rate}", f"round({_SLICE}, 9)"))
def discrete_gamma_rates(spark, d):
    return _categories(spark, d, lambda m, c: m.rate(c))


@query(_SLICES.replace("{rate}", f"round(1.3 * {_SLICE}, 9)"))
def selected_categories(spark, d):
    """The model of each category alone."""
    return _categories(spark, d, lambda m, c: models.select_category(GTR, m, c).rate)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(c AS INTEGER) AS category, CAST(greatest(1, n_nationkey) AS BIGINT) AS categories, CASE WHEN n_nationkey = 0 THEN 1 ELSE 0.5 + c END AS rate, round(1 / greatest(1, n_nationkey), 12) AS weight, 'no category ' || greatest(1, n_nationkey) AS beyond FROM nation, range(40) r(c) WHERE c < greatest(1, n_nationkey)""")
def mixture_accessors(spark, d):
    """A mixture for each nation, of as many categories as its number; nation 0 has none, which counts as one of rate 1."""

    def make(pdf):
        rows = [(n, c, m.count, m.rate(c), round(m.weight(c), 12), _refused(lambda m=m: m.rate(m.count))) for n in pdf["n_nationkey"].tolist() for m in [RateMixture(tuple(0.5 + i for i in range(n)), (1 / n,) * n if n else ())] for c in range(m.count)]
        return pd.DataFrame(rows, columns=["nation", "category", "categories", "rate", "weight", "beyond"])

    return _mapped(read(spark, d, "nation").select("n_nationkey"), "nation long, category int, categories long, rate double, weight double, beyond string", make)


# --- refusals


def _refused(make) -> str | None:
    try:
        make()
    except (ValueError, IndexError) as e:
        return str(e)
    return None


def _bad_model(k: int, x: float):
    """The k-th kind of a wrong model, with a supplier's number in it."""
    quarter, ones = (0.25,) * 4, (1.0,) * 6
    return [
        lambda: NucleotideModel((0.0, 0.4, 0.3, 0.3), ones).validate(), lambda: NucleotideModel((0.25, 0.25, 0.25, 0.250002 + x), ones).validate(), lambda: NucleotideModel(quarter, ones, 1.0, (-0.1, 0.5, 0.3, 0.3)).validate(),
        lambda: NucleotideModel(quarter, (1.0, 1.0, -1.0 - x, 1.0, 1.0, 1.0)).validate(), lambda: NucleotideModel(quarter, (1.0,) * 5).validate(), lambda: jukes_cantor(math.inf), lambda: hky(quarter, -1.0 - x),
        lambda: models.rate_matrix(NucleotideModel(quarter, (0.0,) * 6)), lambda: RateMixture((1.0,), ()), lambda: RateMixture((1.0, 1.0 + x), (0.5, 0.4)), lambda: RateMixture((0.0, 2.0 + x), (0.5, 0.5)),
        lambda: discrete_gamma(1.0 + x, 4).rate(4), lambda: models.transitions(jukes_cantor(), np.array([-1.0 - x])), lambda: models.transitions(jukes_cantor(1e200), np.array([1e200])), lambda: NucleotideModel(quarter, ones, 1.0 + x, (0.0, 1.0, 0.0, 0.0)).validate(),
    ][k]


@query("""SELECT CAST(s_suppkey AS BIGINT) AS supplier, ['stationary frequencies must be positive and sum to 1', 'stationary frequencies must be positive and sum to 1', 'root frequencies must not be negative and must sum to 1',
'exchangeabilities must be finite and not negative', 'a model has 4 frequencies and 6 exchangeabilities', 'the rate must be finite and not negative', 'kappa must be finite and not negative', 'the expected rate must be positive', 'as many weights as rates', 'weights must sum to 1',
'rates and weights must be positive and finite', 'no category 4', 'branch lengths must be finite and not negative', 'rate times length overflows', NULL][CAST(s_suppkey % 15 + 1 AS INTEGER)] AS fault FROM supplier""")
def model_faults(spark, d):
    make = lambda pdf: pd.DataFrame({"supplier": pdf["s_suppkey"], "fault": [_refused(_bad_model(k % 15, k / 100)) for k in pdf["s_suppkey"].tolist()]})
    return _mapped(read(spark, d, "supplier").select("s_suppkey"), "supplier long, fault string", make)


@query("""SELECT CAST(s_suppkey AS BIGINT) AS supplier, [NULL, 'two leaves at least', 'counts must be positive', 'the mode is one of full-input-update, factor-update, fixed-model', 'several categories need a gamma shape, and the other way round',
'a tree needs an alignment, and the other way round', 'weights need an alignment', 'a height is positive and of synthetic trees', 'resident modes take all sites in one batch', 'the least length must not be negative', 'unknown option: --bogus' || s_suppkey, 'no value: --leaves',
'no number: --leaves x' || s_suppkey, 'given twice: --leaves'][CAST(s_suppkey % 14 + 1 AS INTEGER)] AS fault FROM supplier""")
def command_line_faults(spark, d):
    def line(k: int) -> str:
        kinds = (f"--leaves {8 + k} --sites=16", "--leaves 1", "--sites 0", f"--benchmark-mode guess{k}", f"--rate-categories {4 + k}", f"--newick {k}.nwk", f"--pattern-weights w{k}", f"--root-to-tip-distance -{1 + k}", "--benchmark-mode fixed-model --site-batch 5", f"--minimum-branch-length -{1 + k}", f"--bogus{k} 1", "--leaves", f"--leaves x{k}", f"--leaves 4 --leaves {k}")
        return kinds[k % 14]

    make = lambda pdf: pd.DataFrame({"supplier": pdf["s_suppkey"], "fault": [_refused(lambda k=k: runs.parse_options(line(k).split())) for k in pdf["s_suppkey"].tolist()]})
    return _mapped(read(spark, d, "supplier").select("s_suppkey"), "supplier long, fault string", make)


@query("SELECT ['(a', '(a', '(a', '(a', '(''a', '(a', 'a'][CAST(s_suppkey % 7 + 1 AS INTEGER)] || s_suppkey || [',b)', ',);', ':-1,b);', ',b)x;y', ',b);', '[,b);', ',b;'][CAST(s_suppkey % 7 + 1 AS INTEGER)] AS text, CAST([5, 3, 3, 7, 1, 2, 1][CAST(s_suppkey % 7 + 1 AS INTEGER)] + CASE WHEN s_suppkey % 7 = 4 THEN 0 ELSE length(CAST(s_suppkey AS VARCHAR)) END AS INTEGER) AS \"at\" FROM supplier")
def newick_faults(spark, d):
    key = F.col("s_suppkey").cast("string")
    kinds = [("(a", ",b)"), ("(a", ",);"), ("(a", ":-1,b);"), ("(a", ",b)x;y"), ("('a", ",b);"), ("(a", "[,b);"), ("a", ",b;")]
    texts = F.element_at(F.array(*[F.concat(F.lit(a), key, F.lit(b)) for a, b in kinds]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return sources.faults(read(spark, d, "supplier").select(texts.alias("text")), sources.parse_newick)


@query("SELECT 'run-' || count(*) AS identity FROM nation")
def run_identity(spark, d):
    """The identity that the logs of all nations are marked with."""
    nations = read(spark, d, "nation")
    n = nations.count()
    line = F.element_at(F.array(F.lit("# study=s"), F.lit(f"# run_identity=run-{n}"), F.concat(F.lit("cuda,"), F.col("n_nationkey").cast("string"))), F.col("k") + 1)
    lines = nations.select(F.col("n_name").alias("file"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return _small(spark, [(runs.run_identity(lines.select("file", F.col("k").cast("long").alias("line_no"), line.alias("line"))),)], "identity string")


# --- schedules and generators


@query("SELECT CAST(i AS BIGINT) AS record, CAST(i // 3 AS BIGINT) AS case_no, CAST(i % 3 AS BIGINT) AS order_no, ['cpu', 'gpu', 'base'][CAST((i // 3 + i % 3) % 3 + 1 AS INTEGER)] AS method FROM range((SELECT 3 * count(*) FROM supplier)) r(i)")
def cyclic_schedule(spark, d):
    """A case for each supplier."""
    return generate.cyclic_schedule(spark, read(spark, d, "supplier").count(), ["cpu", "gpu", "base"])


@query("SELECT CAST(i AS BIGINT) AS record FROM range((SELECT 3 * count(*) FROM supplier)) r(i) WHERE i % 7 = 5")
def schedule_faults(spark, d):
    methods = ["cpu", "gpu", "base"]
    rows = cyclic_schedule(spark, d)
    return report.schedule_faults(rows.withColumn("method", F.when(F.col("record") % 7 == 5, F.concat("method", F.lit("?"))).otherwise(F.col("method"))), methods).select("record")


def _cases(spark, d) -> DataFrame:
    """A tree for each nation: its kind and size by the nation's number, which is its seed too."""
    kind = F.element_at(F.array(*map(F.lit, generate.TOPOLOGIES)), (F.col("n_nationkey") % len(generate.TOPOLOGIES) + 1).cast("int"))
    return read(spark, d, "nation").select(kind.alias("kind"), (32 + 3 * F.col("n_nationkey")).alias("leaves"), F.col("n_nationkey").alias("seed"))


@query()
def synthetic_topologies(spark, d):
    return generate.topologies(_cases(spark, d))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS seed, leaves, 2 * leaves - 1 AS nodes, leaves - 1 AS inner_nodes, CAST(2 AS BIGINT) AS least_children, CAST(2 AS BIGINT) AS most_children, CAST(1 AS BIGINT) AS roots,
CAST(CASE n_nationkey % 5 WHEN 1 THEN leaves - 1 WHEN 0 THEN ceil(log2(leaves)) END AS BIGINT) AS height FROM (SELECT n_nationkey, CAST(32 + 3 * n_nationkey AS BIGINT) AS leaves FROM nation)""")
def topology_invariants(spark, d):
    """What holds of every topology: two children a node, one root, and the height where it does not depend on chance."""
    nodes = generate.topologies(_cases(spark, d))
    inner = nodes.where("parent_id IS NOT NULL").groupBy("seed", "parent_id").count()
    inner = inner.groupBy("seed").agg(F.count("*").alias("inner_nodes"), F.min("count").alias("least_children"), F.max("count").alias("most_children"))
    whole = nodes.groupBy("seed", "leaves").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent_id").isNull()).alias("roots"))

    def height(key, pdf):
        fixed = key[1] in ("balanced", "caterpillar")
        shape = Tree(pdf.sort_values("node_id")["parent_id"].fillna(-1).to_numpy(), np.zeros(len(pdf))).shape()
        return pd.DataFrame({"seed": [key[0]], "height": [int(shape["height"]) if fixed else None]})

    heights = nodes.groupBy("seed", "kind").applyInPandas(height, "seed long, height long")
    return whole.join(inner, "seed").join(heights, "seed")


_M = "18446744073709551616::UHUGEINT"


def _first_sql(x: str) -> str:
    """The first number of a stream, of an expression of type UBIGINT."""
    h = f"CAST(({x}::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M} AS UBIGINT)"
    for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
        h = f"CAST((xor({h}, {h} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_M} AS UBIGINT)"
    return f"xor({h}, {h} >> 31)"


@query(f"SELECT CAST(k AS INTEGER) AS k, round(0.02 + 0.18 * CAST(h >> 11 AS DOUBLE) / 9007199254740992.0, 12) AS length FROM (SELECT k, {_first_sql('CAST(7 + k AS UBIGINT)')} AS h FROM range((SELECT count(*) FROM part)) r(k))")
def default_lengths(spark, d):
    """A length for each part."""
    n = read(spark, d, "part").count()
    number = lambda pdf: pd.DataFrame({"k": pdf["id"].astype("int32"), "length": np.round(generate.numbered_lengths(pdf["id"].to_numpy(), 7), 12)})
    return _mapped(spark.range(n), "k int, length double", number)


_PATTERN_CELL = _first_sql("CAST((xor(20260813::UBIGINT, CAST((site::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT))::UHUGEINT + k::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)")


def _patterns_sql(leaves: int) -> str:
    return f"""SELECT CAST(site AS BIGINT) AS site, string_agg('0' || [1, 2, 4, 8][CAST(state + 1 AS INTEGER)], '' ORDER BY k) AS masks FROM (
SELECT site, k, CASE WHEN k < spelled THEN CAST((site >> CAST(2 * k AS INTEGER)) & 3 AS BIGINT) ELSE CAST(({_PATTERN_CELL}) & 3::UBIGINT AS BIGINT) END AS state
FROM range((SELECT count(*) FROM part)) s(site), range({leaves}) r(k), (SELECT min(x) AS spelled FROM range(1, 20) t(x) WHERE power(4, x) >= (SELECT count(*) FROM part))) GROUP BY 1"""


def _drawn(spark, d, leaves: int) -> DataFrame:
    return generate.spelled_patterns(spark, read(spark, d, "part").count(), leaves, 20260813).select("site", F.hex("masks").alias("masks"))


@query(_patterns_sql(10))
def drawn_patterns(spark, d):
    """As many columns as there are parts; distinct up to 4^10 of them, as ten leaves spell no more."""
    return _drawn(spark, d, 10)


@query(_patterns_sql(16))
def unique_patterns(spark, d):
    return _drawn(spark, d, 16)


# Fingerprints of simulated alignments, by the topology they follow.
_FINGERPRINTS = [("yule", "2641326333024873219"), ("beta-critical", "10536925141760390345"), ("uniform", "10735218043514194703"), ("caterpillar", "5234058107032935918")]


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, kind, fingerprint FROM nation JOIN (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_FINGERPRINTS)) + ") v(k, kind, fingerprint) ON n_nationkey % 4 = k")
def simulated_fingerprints(spark, d):
    """Each nation's alignment, simulated in the task that has the nation."""

    def one(kind: str) -> str:
        parents = generate.topology(kind, 32, 71)
        bare = Tree(parents, np.zeros(len(parents)))
        return str(randomness.fnv1a(generate.simulate_jukes_cantor(Tree(parents, bare.clock_like(0.1)), 64, 8128).tobytes()))

    def make(pdf):
        kinds = [_FINGERPRINTS[n % 4][0] for n in pdf["n_nationkey"].tolist()]
        return pd.DataFrame({"nation": pdf["n_nationkey"], "kind": kinds, "fingerprint": [one(k) for k in kinds]})

    return _mapped(read(spark, d, "nation").select("n_nationkey"), "nation long, kind string, fingerprint string", make)


@query("""WITH p(k, profile, leaves, sites, heights, n) AS (VALUES (0, 'smoke', [128, 512], [256, 1024], [0.001, 0.1], 3), (1, 'paper', [128, 1024, 8192], [256, 2048, 8192], [0.0001, 0.001, 0.01, 0.1], 10), (2, 'stress', [100, 1000, 10000], [1000, 10000, 100000], [0.0001, 0.001, 0.01, 0.1], 3))
SELECT CAST(r_regionkey AS BIGINT) AS region, profile, topology, CAST(l AS INTEGER) AS leaves, CAST(s AS INTEGER) AS sites, CAST(h AS DOUBLE) AS height, CAST(r AS INTEGER) AS replicate FROM region JOIN (SELECT k, profile, n, unnest(leaves) AS l, sites, heights FROM p) a ON r_regionkey % 3 = k, (VALUES ('balanced'), ('caterpillar'), ('yule'), ('beta-critical')) t(topology), unnest(a.sites) us(s), unnest(a.heights) uh(h), range(10) q(r) WHERE r < n""")
def study_grids(spark, d):
    """Each region's study, of the profile that its number names."""
    out = None
    for k, profile in enumerate(("smoke", "paper", "stress")):
        regions = read(spark, d, "region").where(F.col("r_regionkey") % 3 == k).select(F.col("r_regionkey").alias("region"), F.lit(profile).alias("profile"))
        one = regions.crossJoin(F.broadcast(generate.study_cases(spark, profile)))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH n AS (SELECT (SELECT count(*) FROM nation) AS leaves, (SELECT count(*) FROM supplier) AS sites)
SELECT name, CAST(leaves AS BIGINT) AS leaves, CAST(2 * leaves - 1 AS BIGINT) AS nodes, CAST(m * sites AS BIGINT) AS weight, CAST(CASE WHEN name = 'floored' THEN 2 * leaves - 2 ELSE 0 END AS BIGINT) AS floored, name <> 'clock' AS distinct_columns FROM n, (VALUES ('patterns', 3), ('floored', 1), ('clock', 20)) v(name, m)""")
def made_problems(spark, d):
    """Problems of a leaf for each nation and sites by the number of suppliers: distinct columns, raised lengths, and a simulated alignment whose weights add up to its sites."""
    leaves, sites = read(spark, d, "nation").count(), read(spark, d, "supplier").count()
    cases = {"patterns": f"--sites {3 * sites} --topology yule", "floored": f"--sites={sites} --minimum-branch-length=0.5", "clock": f"--sites {20 * sites} --topology beta-critical --root-to-tip-distance 0.01"}
    out = None
    for name, line in cases.items():
        problem = runs.make_problem(spark, runs.parse_options([f"--leaves={leaves}", *line.split()]))
        row = problem.sites.agg(F.lit(name).alias("name"), F.lit(int(problem.shape["leaves"])).cast("long").alias("leaves"), F.lit(problem.tree.size).cast("long").alias("nodes"), F.sum("weight").cast("long").alias("weight"), F.lit(problem.floored).cast("long").alias("floored"), (F.count_distinct("masks") == F.sum("weight")).alias("distinct_columns"))
        out = row if out is None else out.unionByName(row)
    return out
