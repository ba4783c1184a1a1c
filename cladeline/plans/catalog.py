"""Queries of the engine over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generate, models, randomness, trees
from ..functions.models import RateMixture, discrete_gamma, gtr, hky, jukes_cantor
from ..operators import corpus, encode, report
from ..operators.infer import Inference, weighted_total
from . import derive, sql
from .derive import read

HKY = hky((0.31, 0.19, 0.27, 0.23), 4.2, 0.8)
GTR = gtr((0.31, 0.19, 0.27, 0.23), (1.2, 3.1, 0.7, 1.8, 4.6, 0.9), 1.3)
ONE, GAMMA4 = RateMixture(), discrete_gamma(0.7, 4)
#: Root, regions and nations: the nodes whose marginals and states are reported.
UPPER = np.arange(31)

_queries: dict = {}
_sql: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if text is not None:
            _sql[f.__name__] = text
        return f

    return add


def _whole() -> None:
    from . import deep, formats, logs, studies, tables  # noqa: F401  each adds its queries


def queries() -> dict:
    _whole()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _whole()
    return dict(_sql)


def _inference(spark, d, model, mixture=ONE) -> Inference:
    return Inference(*derive.tree(spark, d), model, mixture)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- likelihood, marginals, maxima, samples


@query(sql.log_likelihood(jukes_cantor(), ONE))
def loglik_jc69(spark, d):
    return _inference(spark, d, jukes_cantor()).log_likelihoods(derive.sites(spark, d)).select("site", F.round("log_likelihood", 6).alias("log_likelihood"))


@query(sql.log_likelihood(HKY, ONE))
def loglik_hky(spark, d):
    return _inference(spark, d, HKY).log_likelihoods(derive.sites(spark, d)).select("site", F.round("log_likelihood", 6).alias("log_likelihood"))


@query(sql.log_likelihood(GTR, GAMMA4))
def loglik_gtr_gamma4(spark, d):
    return _inference(spark, d, GTR, GAMMA4).log_likelihoods(derive.sites(spark, d)).select("site", F.round("log_likelihood", 6).alias("log_likelihood"))


@query(f"SELECT count(*) AS n_patterns, CAST(count(*) AS BIGINT) AS n_sites, round(sum(log_likelihood), 3) AS total FROM ({sql.log_likelihood(jukes_cantor(), ONE)})")
def total_jc69(spark, d):
    scored = _inference(spark, d, jukes_cantor()).log_likelihoods(derive.sites(spark, d)).withColumn("weight", F.lit(1).cast("long"))
    return weighted_total(scored).withColumn("total", F.round("total", 3))


@query(sql.category_posterior(GTR, GAMMA4))
def category_posterior(spark, d):
    return _inference(spark, d, GTR, GAMMA4).category_posteriors(derive.sites(spark, d)).withColumn("p", F.round("p", 6))


@query(sql.node_marginals(GTR, GAMMA4))
def node_marginals(spark, d):
    return _inference(spark, d, GTR, GAMMA4).node_marginals(derive.sites(spark, d), UPPER).withColumn("p", F.round("p", 6))


@query(sql.edge_marginals(GTR, GAMMA4))
def edge_marginals(spark, d):
    return _inference(spark, d, GTR, GAMMA4).edge_marginals(derive.sites(spark, d), UPPER[1:6]).withColumn("p", F.round("p", 6))


def _states(frame: DataFrame) -> DataFrame:
    upper = F.slice("states", 1, len(UPPER))
    return frame.withColumn("states", F.array_join(F.transform(upper, lambda x: x.cast("string")), ""))


@query(sql.joint_maximum(GTR, GAMMA4))
def joint_map(spark, d):
    out = _inference(spark, d, GTR, GAMMA4).joint_maximum(derive.sites(spark, d))
    return _states(out).withColumn("log_weight", F.round("log_weight", 6)).select("site", "category", "log_weight", "states")


@query(f"SELECT site, log_weight FROM ({sql.joint_maximum(GTR, GAMMA4)})")
def map_weight_check(spark, d):
    return _inference(spark, d, GTR, GAMMA4).map_weights(derive.sites(spark, d)).select("site", F.round("log_weight", 6).alias("log_weight"))


@query(sql.posterior_sample(GTR, GAMMA4))
def posterior_sample(spark, d):
    return _states(_inference(spark, d, GTR, GAMMA4).samples(derive.sites(spark, d), uniform=0.5, nodes=UPPER)).select("site", "category", "states")


@query(f"SELECT site, round(log_likelihood, 5) AS log_likelihood FROM ({sql.log_likelihood(jukes_cantor(), ONE).replace('round(ll, 6)', 'll')})")
def relational_loglik(spark, d):
    """The same pruning as joins and two-phase sums, level by level, without Python."""
    from ..operators.relational import log_likelihoods

    form = models.spectral_form(jukes_cantor())
    return log_likelihoods(derive.tree_nodes(spark, d), derive.observations(spark, d), form, jukes_cantor().root).select("site", F.round("log_likelihood", 5).alias("log_likelihood"))


# --- models


# --- trees and observations

_TREE_SQL = """SELECT 0 AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0.0::DOUBLE AS branch_length
UNION ALL SELECT 1 + r_regionkey, 0, 0.05::DOUBLE + 0.01::DOUBLE * r_regionkey FROM region
UNION ALL SELECT 6 + n_nationkey, 1 + n_regionkey, 0.02::DOUBLE + 0.01::DOUBLE * (n_nationkey % 7) FROM nation
UNION ALL SELECT 31 + s_suppkey, 6 + s_nationkey, 0.01::DOUBLE + 0.0001::DOUBLE * (s_suppkey % 1000) FROM supplier"""


@query(f"SELECT CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, round(branch_length, 9) AS branch_length FROM ({_TREE_SQL})")
def tree_edges(spark, d):
    return derive.tree_nodes(spark, d).withColumn("branch_length", F.round("branch_length", 9))


@query(f"""WITH t AS ({_TREE_SQL}), leaf AS (SELECT node_id FROM t WHERE node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL))
SELECT count(*) AS leaves, CAST(max(depth) AS BIGINT) AS height, CAST(sum(depth) AS BIGINT) AS sackin FROM
(SELECT CASE WHEN node_id >= 31 THEN 3 WHEN node_id >= 6 THEN 2 ELSE 1 END AS depth FROM leaf)""")
def tree_shape(spark, d):
    """Leaves and their depths as rows, by pointer doubling."""
    from ..operators.decompose import tree_shape as shape

    return shape(derive.tree_nodes(spark, d), derive.kept(spark, "shape"))


@query("""SELECT CAST(31 + s_suppkey AS BIGINT) AS node_id, round(0.05::DOUBLE + 0.01::DOUBLE * r_regionkey + 0.02::DOUBLE + 0.01::DOUBLE * (n_nationkey % 7) + 0.01::DOUBLE + 0.0001::DOUBLE * (s_suppkey % 1000), 9) AS distance
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def root_to_tip(spark, d):
    """Distances of the tips by pointer doubling, whatever the depth."""
    from ..operators.decompose import root_distances

    out = root_distances(derive.tree_nodes(spark, d), derive.kept(spark, "distances"))
    return out.where("node_id >= 31").select("node_id", F.round("distance", 9).alias("distance"))


@query("SELECT CAST(count_if(l < 0.03) AS BIGINT) AS raised, round(sum(greatest(l, 0.03::DOUBLE)), 6) AS total FROM (SELECT 0.01::DOUBLE + 0.0001::DOUBLE * (s_suppkey % 1000) AS l FROM supplier)")
def floor_lengths(spark, d):
    least, length = F.lit(0.03), F.col("branch_length")
    edges = derive.tree_nodes(spark, d).where("node_id >= 31")
    return edges.agg(F.count_if(length < least).alias("raised"), F.round(F.sum(F.greatest(length, least)), 6).alias("total"))


_IUPAC_SQL = "CASE WHEN strpos('ACMGRSVTWYHKDB', upper(ch)) > 0 THEN strpos('ACMGRSVTWYHKDB', upper(ch)) WHEN upper(ch) = 'U' THEN 8 WHEN strpos('NX?-.', upper(ch)) > 0 THEN 15 END"


@query(f"SELECT hex(encode(ch)) AS ch, CAST({_IUPAC_SQL} AS INTEGER) AS mask, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ALL")
def iupac_decode(spark, d):
    letters = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("ch"))
    return letters.groupBy("ch").count().select(F.hex(F.col("ch").cast("binary")).alias("ch"), encode.decode(F.col("ch")).alias("mask"), F.col("count").alias("n"))


_OBS_SQL = "SELECT l_orderkey % 512 AS site, 31 + l_suppkey AS node_id, bit_or(CAST(1 << CAST(l_partkey % 4 AS INTEGER) AS INTEGER)) AS mask FROM lineitem GROUP BY 1, 2"


@query(f"SELECT mask, CAST(count_if(mask & 1 <> 0) AS BIGINT) AS a, CAST(count_if(mask & 2 <> 0) AS BIGINT) AS c, CAST(count_if(mask & 4 <> 0) AS BIGINT) AS g, CAST(count_if(mask & 8 <> 0) AS BIGINT) AS t FROM ({_OBS_SQL}) GROUP BY 1")
def mask_allows(spark, d):
    m = F.col("mask")
    return derive.observations(spark, d).groupBy("mask").agg(*[F.count_if(encode.allows(m, s)).alias(x) for s, x in enumerate("acgt")])


def _sequences(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers as leaves, and a made-up sequence for each but every tenth."""
    suppliers = read(spark, d, "supplier")
    leaves = suppliers.select((31 + F.col("s_suppkey")).alias("node_id"), F.col("s_name").alias("label"))
    letter = lambda k: F.substring(F.lit("ACGTRYSWKMBDHVN-"), ((F.col("s_suppkey") * (k + 3) + k) % 16 + 1).cast("int"), F.lit(1))
    return leaves, suppliers.select(F.col("s_name").alias("name"), F.concat(*[letter(k) for k in range(6)]).alias("sequence"), "s_suppkey")


@query("""SELECT CAST(k AS INTEGER) AS site, CAST(31 + s_suppkey AS BIGINT) AS node_id, CAST(CASE WHEN v IN (0, 15) THEN 15 ELSE v END AS INTEGER) AS mask FROM (
SELECT k, s_suppkey, [1, 2, 4, 8, 5, 10, 6, 9, 12, 3, 14, 13, 11, 7, 15, 15][CAST((s_suppkey * (k + 3) + k) % 16 + 1 AS INTEGER)] AS v FROM supplier, range(6) r(k))""")
def encode_observations(spark, d):
    leaves, sequences = _sequences(spark, d)
    return encode.encode(leaves, sequences)


@query("SELECT s_name AS name, 'leaf without sequence' AS side FROM supplier WHERE s_suppkey % 10 = 3 UNION ALL SELECT s_name || 'x', 'sequence without leaf' FROM supplier WHERE s_suppkey % 10 = 7 UNION ALL SELECT s_name, 'leaf without sequence' FROM supplier WHERE s_suppkey % 10 = 7")
def encode_anti_checks(spark, d):
    leaves, sequences = _sequences(spark, d)
    broken = sequences.where("s_suppkey % 10 <> 3").withColumn("name", F.when(F.col("s_suppkey") % 10 == 7, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return encode.mismatches(leaves, broken)


@query(f"SELECT CAST(site AS BIGINT) AS site, count(*) AS observed FROM ({_OBS_SQL}) WHERE site >= 100 AND site < 164 GROUP BY 1")
def select_sites(spark, d):
    return encode.select_sites(derive.observations(spark, d), 100, 64, derive.SITES).groupBy("site").agg(F.count("*").alias("observed"))


_NARROW_SQL = "SELECT site, " + ", ".join(f"coalesce(bit_or(CASE WHEN l_linenumber = {k} THEN CAST(1 << CAST(l_partkey % 4 AS INTEGER) AS INTEGER) END), 15) AS m{k}" for k in range(1, 5)) + " FROM (SELECT l_orderkey AS site, l_linenumber, l_partkey FROM lineitem) GROUP BY 1"
_PATTERN_SQL = f"SELECT m1, m2, m3, m4, count(*) AS weight, min(site) AS first_site FROM ({_NARROW_SQL}) GROUP BY 1, 2, 3, 4"
_CELLS = ["m1", "m2", "m3", "m4"]


@query(f"SELECT CAST(m1 AS INTEGER) AS m1, CAST(m2 AS INTEGER) AS m2, CAST(m3 AS INTEGER) AS m3, CAST(m4 AS INTEGER) AS m4, weight, CAST(first_site AS BIGINT) AS first_site, CAST(row_number() OVER (ORDER BY first_site) - 1 AS BIGINT) AS pattern FROM ({_PATTERN_SQL})")
def pattern_compress(spark, d):
    return encode.numbered(encode.compress(derive.narrow_columns(spark, d), _CELLS))


def _star_sql() -> str:
    form = models.spectral_form(HKY)
    lengths = derive.star()[0].lengths
    p = {(k, a, b): float(sum(form.coef[e, a, b] * np.exp(form.lam[e] * lengths[k]) for e in range(4))) for k in range(1, 5) for a in range(4) for b in range(4)}
    term = lambda k, a: "(" + " + ".join(f"CASE WHEN m{k} & {1 << b} <> 0 THEN {p[k, a, b]!r}::DOUBLE ELSE 0 END" for b in range(4)) + ")"
    return "ln(" + " + ".join(f"{float(HKY.root[a])!r}::DOUBLE * " + " * ".join(term(k, a) for k in range(1, 5)) for a in range(4)) + ")"


@query(f"SELECT count(*) AS n_patterns, CAST(sum(weight) AS BIGINT) AS n_sites, round(sum(weight * {_star_sql()}), 4) AS total FROM ({_PATTERN_SQL})")
def weighted_total_patterns(spark, d):
    """Compression first, the kernel on distinct columns only, and weights in the sum."""
    tree, ids = derive.star()
    patterns = encode.compress(derive.narrow_columns(spark, d), _CELLS).withColumnRenamed("first_site", "site")
    sites = patterns.withColumn("nodes", F.array(*[F.lit(k) for k in ids[1:]])).withColumn("masks", F.array(*_CELLS))
    scored = Inference(tree, np.array(ids), HKY).log_likelihoods(sites).join(patterns.select("site", "weight"), "site")
    return weighted_total(scored).withColumn("total", F.round("total", 4))


_COVERAGE_SQL = f"SELECT site, CAST(count_if(bit_count(mask) = 1) AS BIGINT) AS covered, bit_or(CASE WHEN bit_count(mask) = 1 THEN mask ELSE 0 END) AS states FROM ({_OBS_SQL}) GROUP BY 1"


@query(f"SELECT CAST(site AS BIGINT) AS site, covered, CAST(states AS INTEGER) AS states, bit_count(states) > 1 AS variable FROM ({_COVERAGE_SQL})")
def column_coverage(spark, d):
    return encode.column_coverage(derive.observations(spark, d))


@query(f"SELECT count(*) AS variable_columns FROM ({_COVERAGE_SQL}) WHERE bit_count(states) > 1")
def variable_columns(spark, d):
    return encode.column_coverage(derive.observations(spark, d)).where("variable").agg(F.count("*").alias("variable_columns"))


@query(f"""WITH r AS (SELECT covered, row_number() OVER (ORDER BY covered) - 1 AS i, count(*) OVER () AS n FROM ({_COVERAGE_SQL}))
SELECT CAST(percent AS INTEGER) AS percent, covered AS value FROM r JOIN (VALUES (0), (10), (50), (90), (100)) p(percent) ON i = CAST(round_even((n - 1) * percent / 100.0, 0) AS BIGINT)""")
def coverage_quantiles(spark, d):
    return corpus.coverage_quantiles(encode.column_coverage(derive.observations(spark, d)), "covered", [0, 10, 50, 90, 100])


@query(f"SELECT CAST(site AS BIGINT) AS site FROM ({_COVERAGE_SQL}) WHERE covered >= ceil(0.3 * (SELECT count(*) FROM supplier))")
def eligible_columns(spark, d):
    taxa = read(spark, d, "supplier").count()
    return corpus.eligible_columns(encode.column_coverage(derive.observations(spark, d)), taxa, 0.3).select("site")


# --- hashes, ranks and selection



def _splitmix_sql(x: str) -> str:
    h = f"(({x})::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT"
    a = f"SELECT id, CAST({h} AS UBIGINT) AS h FROM src"
    b = "SELECT id, CAST((xor(h, h >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS h FROM a"
    c = "SELECT id, CAST((xor(h, h >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS h FROM b"
    return f"a AS ({a}), b AS ({b}), c AS ({c}), hashed AS (SELECT id, xor(h, h >> 31) AS h FROM c)"


_HASH_SQL = f"WITH src AS (SELECT doc_id AS id, xor(doc_id::UBIGINT, 20260813::UBIGINT) AS x FROM documents), {_splitmix_sql('x')}"


@query(f"{_HASH_SQL} SELECT CAST(id AS BIGINT) AS id, CAST(h::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) AS rank FROM hashed")
def splitmix_rank(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), randomness.splitmix(20260813)("doc_id").alias("rank"))


@query(f"{_HASH_SQL} SELECT CAST(id AS BIGINT) AS id FROM (SELECT id FROM hashed ORDER BY h, id LIMIT 64)")
def select_coordinates(spark, d):
    return corpus.lowest(splitmix_rank(spark, d), "rank", "id", 64).select("id")


_RANK_SQL = "sha256('cladeline-rank' || chr(0) || CAST(doc_id AS VARCHAR))"


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {_RANK_SQL} AS rank FROM documents WHERE lang = 'en' ORDER BY 2 LIMIT 25")
def hash_rank_topk(spark, d):
    rank = randomness.stable_rank("cladeline-rank", F.col("doc_id").cast("string"))
    return corpus.first_by_rank(read(spark, d, "documents").select("doc_id", "lang"), rank, F.col("lang") == "en", 25)[0].select("doc_id", "rank")


@query(f"WITH r AS (SELECT doc_id, lang, {_RANK_SQL} AS rank FROM documents), k AS (SELECT max(rank) AS last FROM (SELECT rank FROM r WHERE lang = 'en' ORDER BY rank LIMIT 25)) SELECT CAST(doc_id AS BIGINT) AS doc_id, lang FROM r, k WHERE lang <> 'en' AND rank <= last")
def hash_rank_excluded(spark, d):
    rank = randomness.stable_rank("cladeline-rank", F.col("doc_id").cast("string"))
    return corpus.first_by_rank(read(spark, d, "documents").select("doc_id", "lang"), rank, F.col("lang") == "en", 25)[1].select("doc_id", "lang")


_EDGES = [100, 1000, 4000, 16000, 40000]
_BIN_SQL = "CASE WHEN n_chars >= 40000 THEN NULL WHEN n_chars >= 16000 THEN 3 WHEN n_chars >= 4000 THEN 2 WHEN n_chars >= 1000 THEN 1 WHEN n_chars >= 100 THEN 0 END"


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(bin AS INTEGER) AS bin, CAST(place AS INTEGER) AS place FROM (SELECT doc_id, {_BIN_SQL} AS bin, row_number() OVER (PARTITION BY {_BIN_SQL} ORDER BY {_RANK_SQL}) AS place FROM documents WHERE n_chars >= 100 AND n_chars < 40000) WHERE place <= 20")
def stratified_topk(spark, d):
    rank = randomness.stable_rank("cladeline-rank", F.col("doc_id").cast("string"))
    return corpus.stratified(read(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), _EDGES, rank, 20).select("doc_id", "bin", "place")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, 'set-' || regexp_replace(n_name, '[^A-Za-z0-9._-]+', '-', 'g') || '-' || substr(sha256(n_name), 1, 12) AS dataset FROM nation")
def dataset_ids(spark, d):
    return read(spark, d, "nation").select("n_nationkey", randomness.dataset_id(F.col("n_name"), "set-").alias("dataset"))


# --- reports; line items stand for measurements: flag = method, supplier = problem, line number = batch

_MEDIANS = "SELECT l_returnflag AS method, l_suppkey AS problem, l_linenumber AS batch, median(l_extendedprice) AS median_elapsed, max(l_tax) AS max_l_tax, count(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3"


def _medians(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("problem"), F.col("l_linenumber").alias("batch"), "l_extendedprice", "l_tax")
    return report.median_rows(rows, ["method", "problem", "batch"], "l_extendedprice", ["l_tax"])


@query(f"SELECT method, CAST(problem AS BIGINT) AS problem, CAST(batch AS INTEGER) AS batch, round(median_elapsed, 6) AS median_elapsed, max_l_tax, n_rows FROM ({_MEDIANS})")
def median_rows(spark, d):
    return _medians(spark, d).withColumn("median_elapsed", F.round("median_elapsed", 6))


_BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, problem ORDER BY median_elapsed, batch DESC) AS place FROM ({_MEDIANS})) WHERE place = 1"


@query(f"SELECT method, CAST(problem AS BIGINT) AS problem, CAST(batch AS INTEGER) AS batch, round(median_elapsed, 6) AS median_elapsed FROM ({_BEST})")
def best_batch(spark, d):
    out = report.best_batch(_medians(spark, d), ["method", "problem"], "median_elapsed", "batch")
    return out.select("method", "problem", "batch", F.round("median_elapsed", 6).alias("median_elapsed"))


_PAIRS = f"SELECT a.problem, a.median_elapsed AS left_value, b.median_elapsed AS right_value, b.median_elapsed / a.median_elapsed AS ratio FROM ({_BEST}) a JOIN ({_BEST}) b ON a.problem = b.problem WHERE a.method = 'A' AND b.method = 'N'"


def _pairs(spark, d) -> DataFrame:
    return report.paired(report.best_batch(_medians(spark, d), ["method", "problem"], "median_elapsed", "batch"), ["problem"], "method", "A", "N", "median_elapsed")


@query(f"SELECT CAST(problem AS BIGINT) AS problem, round(ratio, 6) AS ratio FROM ({_PAIRS})")
def paired_ratio(spark, d):
    return _pairs(spark, d).select("problem", F.round("ratio", 6).alias("ratio"))


@query(f"SELECT CAST(problem % 5 AS BIGINT) AS comparison, count(*) AS n_pairs, CAST(count_if(ratio > 1) AS BIGINT) AS wins, round(min(ratio), 6) AS least, round(median(ratio), 6) AS median, round(quantile_cont(ratio, 0.9), 6) AS p90, round(max(ratio), 6) AS most FROM ({_PAIRS}) GROUP BY 1")
def corpus_summary(spark, d):
    out = report.ratio_summary(_pairs(spark, d).withColumn("comparison", F.col("problem") % 5), ["comparison"])
    return out.select("comparison", "n_pairs", "wins", *[F.round(c, 6).alias(c) for c in ("least", "median", "p90", "most")])


@query(f"SELECT CAST(problem % 4 AS BIGINT) AS cell, round(median(log2(ratio)), 6) AS median_log2_ratio FROM ({_PAIRS}) GROUP BY 1")
def heat_cells(spark, d):
    return report.heat_cells(_pairs(spark, d).withColumn("cell", F.col("problem") % 4), ["cell"]).withColumn("median_log2_ratio", F.round("median_log2_ratio", 6))


@query(f"""WITH p AS ({_PAIRS}), b(bin, label, lo, hi) AS (VALUES (0, '1–9', 0, 10), (1, '10–29', 10, 30), (2, '30–59', 30, 60), (3, '60–999,999', 60, 1000000), (4, '≥1,000,000', 1000000, 1000000000000))
SELECT CAST(bin AS INTEGER) AS bin, label, count(ratio) AS n, round(median(ratio), 6) AS median_ratio, round(min(ratio), 6) AS min_ratio, round(max(ratio), 6) AS max_ratio FROM b LEFT JOIN p ON problem >= lo AND problem < hi GROUP BY 1, 2""")
def taxa_bins(spark, d):
    out = report.bin_summary(_pairs(spark, d), "problem", "ratio", [0, 10, 30, 60, 1_000_000, float("inf")])
    return out.select("bin", "label", "n", *[F.round(c, 6).alias(c) for c in ("median_ratio", "min_ratio", "max_ratio")])


_COVER = "SELECT DISTINCT l_returnflag AS method, l_suppkey AS problem FROM lineitem WHERE (l_suppkey % 7 <> 0 OR l_returnflag <> 'R') AND (l_suppkey % 11 <> 0 OR l_returnflag <> 'A')"


@query(f"WITH c AS ({_COVER}) SELECT CAST(problem AS BIGINT) AS problem, 'R' AS missing FROM c WHERE method = 'A' AND problem NOT IN (SELECT problem FROM c WHERE method = 'R') UNION ALL SELECT problem, 'A' FROM c WHERE method = 'R' AND problem NOT IN (SELECT problem FROM c WHERE method = 'A')")
def coverage_diff(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("problem")).where("(problem % 7 <> 0 OR method <> 'R') AND (problem % 11 <> 0 OR method <> 'A')")
    return report.unpaired(rows, ["problem"], "method", "A", "R")


@query("""SELECT flag, CAST(line AS INTEGER) AS line, CAST(month AS INTEGER) AS month FROM (VALUES ('A'), ('N'), ('R')) f(flag), range(1, 9) l(line), range(1, 13) m(month)
EXCEPT SELECT l_returnflag, l_linenumber, CAST(month(l_shipdate) AS INTEGER) FROM lineitem WHERE l_quantity > 48""")
def grid_completeness(spark, d):
    design = generate.case_grid(spark, flag=["A", "N", "R"], line=list(range(1, 9)), month=list(range(1, 13)))
    seen = read(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.month("l_shipdate").alias("month"))
    return report.missing_cells(seen, design)


_LIMITS = "SELECT l_suppkey AS problem, max(l_linenumber) AS lim FROM lineitem WHERE l_quantity >= 49 GROUP BY 1"
_DONE = "SELECT DISTINCT l_suppkey AS problem, l_linenumber AS batch FROM lineitem WHERE l_quantity < 2 AND l_linenumber > 3 AND l_suppkey % 2 = 0"


def _limits(spark, d) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("problem"), F.col("l_linenumber").alias("batch"), "l_quantity")
    return lines.where("l_quantity >= 49").groupBy("problem").agg(F.max("batch").alias("lim")), lines.where("l_quantity < 2 AND batch > 3 AND problem % 2 = 0").select("problem", "batch").distinct()


@query(f"WITH l AS ({_LIMITS}), s AS ({_DONE}) SELECT CAST(problem AS BIGINT) AS problem, CAST(lim AS INTEGER) AS lim FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.problem = l.problem AND s.batch < l.lim)")
def capacity_evidence(spark, d):
    return report.unsupported_limits(*_limits(spark, d), ["problem"], "batch", "lim")


@query(f"WITH l AS ({_LIMITS}), s AS ({_DONE}) SELECT CAST(problem AS BIGINT) AS problem, CAST(batch AS INTEGER) AS batch FROM s WHERE EXISTS (SELECT 1 FROM l WHERE s.problem = l.problem AND l.lim <= s.batch)")
def capacity_reached(spark, d):
    limits, done = _limits(spark, d)
    return report.reached(done, limits, ["problem"], "batch", "lim")


@query("SELECT CAST(s_suppkey AS BIGINT) AS problem, CAST(batch AS INTEGER) AS batch FROM supplier, range(1, 8) b(batch) EXCEPT SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40")
def resume_skip(spark, d):
    planned = read(spark, d, "supplier").select(F.col("s_suppkey").alias("problem"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("batch"))
    done = read(spark, d, "lineitem").where("l_returnflag = 'A' AND l_quantity > 40").select(F.col("l_suppkey").alias("problem"), F.col("l_linenumber").alias("batch"))
    return report.to_resume(planned, done, ["problem", "batch"])


_BLOCKS = "SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM events"


@query(f"SELECT CAST(user_id AS BIGINT) AS user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events FROM ({_BLOCKS}) GROUP BY 1, 2")
def block_sessions(spark, d):
    return report.sessions(read(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "signup").groupBy("user_id", "session").agg(F.count("*").alias("n_events"))


@query("SELECT CAST(event_id AS BIGINT) AS event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS active FROM events")
def carry_forward(spark, d):
    return report.carry_forward(read(spark, d, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")), "active").select("event_id", "active")


@query("""SELECT count(*) AS n, round(max(abs(x - y)), 6) AS max_abs, round(max(abs(x - y) / greatest(1, abs(y))), 9) AS max_rel, CAST(count_if(x <> y) AS BIGINT) AS mismatches
FROM (SELECT o_totalprice AS y, o_totalprice + (o_orderkey % 3) * 0.01 AS x FROM orders)""")
def error_metrics(spark, d):
    orders = read(spark, d, "orders")
    actual = orders.select("o_orderkey", (F.col("o_totalprice") + (F.col("o_orderkey") % 3) * 0.01).alias("value"))
    out = report.error_metrics(actual, orders.select("o_orderkey", F.col("o_totalprice").alias("value")), ["o_orderkey"], "value")
    return out.select("n", F.round("max_abs", 6).alias("max_abs"), F.round("max_rel", 9).alias("max_rel"), "mismatches")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS problem, CASE WHEN n <= 512 THEN CAST(n AS VARCHAR) WHEN n <= 1024 THEN CASE WHEN n = 1024 THEN '512,256,1024' ELSE '512,256,' || n END ELSE '512,256,1024,' || n END AS batches
FROM (SELECT s_suppkey, s_suppkey * 37 + 1 AS n FROM supplier)""")
def expected_batches(spark, d):
    """Requested in an order that is not rising: the first batch that holds everything ends the list."""
    batches = report.expected_batches([512, 256, 1024], F.col("s_suppkey") * 37 + 1)
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("problem"), F.array_join(batches, ",").alias("batches"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS problem, CAST(greatest(1, least(5, 20000000 // ((2 * (s_suppkey * 100 + 2) - 1) * 256))) AS BIGINT) AS repeats FROM supplier")
def timing_repeats(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("problem"), report.timing_repeats(F.col("s_suppkey") * 100 + 2, F.lit(256), 20_000_000, 1, 5).alias("repeats"))


# --- generators and streams


@query(f"SELECT CAST(m1 AS INTEGER) AS m1, CAST(m2 AS INTEGER) AS m2, CAST(m3 AS INTEGER) AS m3, CAST(m4 AS INTEGER) AS m4, weight FROM ({_PATTERN_SQL})")
def stream_patterns(spark, d):
    from ..streaming.streams import running_patterns

    return running_patterns(spark, derive.narrow_columns(spark, d), _CELLS)


@query("SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, CAST(bucket AS BIGINT) AS bucket FROM (SELECT event_id, user_id, bucket, max(bucket) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_id, user_id, event_id * 10 // (SELECT count(*) FROM events) AS bucket FROM events)) WHERE before IS NULL OR bucket > before")
def stream_progress(spark, d):
    from ..streaming.streams import progress_milestones

    events = read(spark, d, "events")
    n = events.count()
    return progress_milestones(spark, events.select("event_id", "user_id", F.expr(f"event_id * 10 div {n}").alias("bucket")))


@query(sql.log_likelihood(jukes_cantor(), ONE))
def stream_score(spark, d):
    from ..streaming.streams import scored_stream

    inference = _inference(spark, d, jukes_cantor())
    return scored_stream(spark, derive.sites(spark, d), inference).select("site", F.round("log_likelihood", 6).alias("log_likelihood"))


