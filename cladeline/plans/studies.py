"""Queries over models, generators and runs: presets, closed forms, seeds, grids, capacity, modes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import models, randomness
from ..functions.models import jukes_cantor
from ..operators import report, runs
from ..operators.infer import Resident
from ..streaming.streams import folder
from . import derive, sql
from .catalog import _BEST, GAMMA4, GTR, ONE, _inference, _small, query
from .derive import read

# --- models


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, round(0.25 - 0.25 * exp(-4 * 1.7 / 3 * n_nationkey / 20.0), 12) AS differs, round(0.25 + 0.75 * exp(-4 * 1.7 / 3 * n_nationkey / 20.0), 12) AS same FROM nation")
def jc69_closed_form(spark, d):
    differs, same = models.jukes_cantor_columns(F.col("n_nationkey") / 20.0, 1.7)
    return read(spark, d, "nation").select("n_nationkey", F.round(differs, 12).alias("differs"), F.round(same, 12).alias("same"))


@query(f"SELECT site, round(max(lc), 5) AS best FROM ({sql.log_likelihood(GTR, GAMMA4).replace('SELECT CAST(site AS BIGINT) AS site, round(ll, 6) AS log_likelihood FROM ll', 'SELECT CAST(site AS BIGINT) AS site, lc - ln(0.25) AS lc FROM bycat')}) GROUP BY 1")
def likelihood_by_category(spark, d):
    """Each category alone, as a model of one rate: a site's likelihood in its best one."""
    sites, out = derive.sites(spark, d), None
    for c in range(GAMMA4.count):
        one = _inference(spark, d, models.select_category(GTR, GAMMA4, c)).log_likelihoods(sites)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("site").agg(F.round(F.max("log_likelihood"), 5).alias("best"))


@query(f"SELECT site, round(exp(log_likelihood) * 1e6, 6) AS likelihood FROM ({sql.log_likelihood(jukes_cantor(), ONE).replace('round(ll, 6)', 'll')})")
def site_likelihood(spark, d):
    return _inference(spark, d, jukes_cantor()).likelihoods(derive.sites(spark, d)).select("site", F.round(F.col("likelihood") * 1e6, 6).alias("likelihood"))


_TOTAL = f"SELECT round(sum(log_likelihood), 3) FROM ({sql.log_likelihood(jukes_cantor(), ONE).replace('round(ll, 6)', 'll')})"


@query(f"SELECT mode, ({_TOTAL}) AS total FROM (VALUES ('full-input-update'), ('factor-update'), ('fixed-model')) v(mode)")
def resident_modes(spark, d):
    """The same problem three times: all worked out anew, the factors only, nothing."""
    tree, ids = derive.tree(spark, d)
    problem = Resident(tree, ids, derive.sites(spark, d), folder(spark, "resident"))
    rows = [(mode, problem.evaluate(mode, None if mode == "fixed-model" else jukes_cantor())) for mode in runs.MODES]
    return _small(spark, rows, "mode string, total double").withColumn("total", F.round("total", 3))


@query("SELECT mode, true AS has_batches, true AS within_wall FROM (VALUES ('full-input-update'), ('factor-update'), ('fixed-model')) v(mode)")
def observed_timings(spark, d):
    """Each evaluation's parts, as its tasks observed them: no more than all cores' time, which is what adds up."""
    tree, ids = derive.tree(spark, d)
    problem = Resident(tree, ids, derive.sites(spark, d), folder(spark, "resident"))
    for mode in runs.MODES:
        problem.evaluate(mode, None if mode == "fixed-model" else jukes_cantor())
    cores = spark.sparkContext.defaultParallelism
    rows = [(mode, t["batches"] >= 1, 0 < t["kernel_s"] <= t["upload_s"] + t["kernel_s"] + t["download_s"] <= cores * t["wall_s"]) for mode, t in zip(runs.MODES, problem.timings, strict=True)]
    return _small(spark, rows, "mode string, has_batches boolean, within_wall boolean")


# --- seeds and generators

_M = "18446744073709551616::UHUGEINT"


def _first_sql(x: str) -> str:
    """The first number of a stream, of an expression of type UBIGINT."""
    h = f"CAST(({x}::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M} AS UBIGINT)"
    for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
        h = f"CAST((xor({h}, {h} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_M} AS UBIGINT)"
    return f"xor({h}, {h} >> 31)"


@query(f"""WITH a AS (SELECT n_nationkey AS k, CAST(64 + n_nationkey AS UBIGINT) AS leaves FROM nation), b AS (SELECT k, {_first_sql("xor(20260813::UBIGINT, leaves)")} AS x FROM a),
c AS (SELECT k, xor(x, f) AS x FROM (SELECT k, x, {_first_sql("CAST((x::UHUGEINT + CAST(k % 3 AS UHUGEINT)) % 18446744073709551616::UHUGEINT AS UBIGINT)")} AS f FROM b)),
d AS (SELECT k, {_first_sql("xor(x, 121::UBIGINT)")} AS x FROM c), e AS (SELECT k, {_first_sql("xor(x, 117::UBIGINT)")} AS x FROM d), f AS (SELECT k, {_first_sql("xor(x, 108::UBIGINT)")} AS x FROM e)
SELECT CAST(k AS INTEGER) AS k, CAST({_first_sql("xor(x, 101::UBIGINT)")} AS VARCHAR) AS seed FROM f""")
def topology_seeds(spark, d):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["n_nationkey"], "seed": [str(randomness.topology_seed(20260813, 64 + int(k), int(k) % 3, "yule")) for k in pdf["n_nationkey"]]})

    return read(spark, d, "nation").select("n_nationkey").mapInPandas(run, "k int, seed string")


_CLOCK_SQL = """WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 1 ELSE 0 END AS h FROM nation),
r AS (SELECT r_regionkey, (SELECT coalesce(1 + max(h), 0) FROM n WHERE n_regionkey = r_regionkey) AS h FROM region), t AS (SELECT 1 + max(h) AS h FROM r)"""


@query(f"""{_CLOCK_SQL} SELECT CAST(31 + s_suppkey AS BIGINT) AS node_id, round(0.4 * (n.h - 0) / t.h, 9) AS length FROM s JOIN n ON s_nationkey = n_nationkey, t
UNION ALL SELECT 6 + n_nationkey, round(0.4 * (r.h - n.h) / t.h, 9) FROM n JOIN r ON n_regionkey = r_regionkey, t UNION ALL SELECT 1 + r_regionkey, round(0.4 * (t.h - r.h) / t.h, 9) FROM r, t UNION ALL SELECT 0, 0.0""")
def clock_lengths(spark, d):
    tree, ids = derive.tree(spark, d)
    return _small(spark, list(zip(ids.tolist(), tree.clock_like(0.4).tolist(), strict=True)), "node_id long, length double").withColumn("length", F.round("length", 9))


# --- runs


@query("""WITH RECURSIVE c AS (SELECT s_suppkey AS k, CAST(1 + s_suppkey * 37 % 900 AS INTEGER) AS fits FROM supplier),
w AS (SELECT k, fits, 1024 AS batch, 0 AS failed FROM c UNION ALL SELECT k, fits, batch // 2, failed + 1 FROM w WHERE batch > fits)
SELECT CAST(k AS BIGINT) AS problem, CAST(min(batch) AS INTEGER) AS batch, CAST(max(failed) AS INTEGER) AS failed, CAST((SELECT count(*) FROM (VALUES (16), (64), (256), (512)) v(x) WHERE x <= any_value(fits)) AS INTEGER) AS runs_up,
CAST((SELECT min(x) FROM (VALUES (16), (64), (256), (512)) v(x) WHERE x > any_value(fits)) AS INTEGER) AS first_infeasible FROM w GROUP BY k""")
def capacity_search(spark, d):
    """Halving from above to the largest batch that fits, and rising from below to the first that does not."""

    def search(fits: int) -> tuple:
        def run(batch):
            if batch > fits:
                raise runs.CapacityError(batch)
            return batch

        batch, _, failed = runs.descending(run, 1024)
        done, limit = runs.ascending(run, [16, 64, 256, 512])
        return batch, len(failed), len(done), limit

    def each(batches):
        for pdf in batches:
            found = [search(1 + int(k) * 37 % 900) for k in pdf["s_suppkey"]]
            yield pd.DataFrame([(int(k), *f) for k, f in zip(pdf["s_suppkey"], found, strict=True)], columns=["problem", "batch", "failed", "runs_up", "first_infeasible"]).astype({"first_infeasible": "Int64"})

    return read(spark, d, "supplier").select("s_suppkey").mapInPandas(each, "problem long, batch int, failed int, runs_up int, first_infeasible int")


@query("SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(floor(least(8e9 + s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 4e9 + s_suppkey * 7 ELSE 8e9 + s_suppkey END) * (20 + s_suppkey % 71) / 100) AS BIGINT) AS bytes FROM supplier")
def memory_limits(spark, d):
    k = F.col("s_suppkey").cast("long")
    host = F.lit(8_000_000_000).cast("long") + k
    return read(spark, d, "supplier").select(k.alias("k"), runs.memory_limit(host, F.when(k % 2 == 0, F.lit(4_000_000_000).cast("long") + k * 7), (20 + k % 71).cast("int")).alias("bytes"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS problem, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS turn FROM supplier")
def resumed_run(spark, d):
    """A run that ends after a third of its cases, taken up again: each case is run once."""
    path, planned = folder(spark, "resumed"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("problem"))
    turn = lambda k: (lambda left: left.withColumn("turn", F.lit(k)))
    runs.resumed(planned.where("problem % 3 = 0"), turn(1), path, ["problem"])
    return runs.resumed(planned, turn(2), path, ["problem"])


@query(f"SELECT CAST(problem AS BIGINT) AS problem, count(*) AS methods FROM ({_BEST}) WHERE method IN ('A', 'R') GROUP BY 1 HAVING count(*) < 2 OR count(*) = 2")
def paired_strict(spark, d):
    """Pairs over problems that have both sides: nothing fails."""
    from .catalog import _medians

    best = report.best_batch(_medians(spark, d), ["method", "problem"], "median_elapsed", "batch")
    whole = best.where("method IN ('A', 'R')").groupBy("problem").agg(F.count("*").alias("methods"))
    pairs = report.paired(best.join(whole.where("methods = 2"), "problem", "left_semi"), ["problem"], "method", "A", "R", "median_elapsed", strict=True)
    return whole.join(pairs.select("problem", F.lit(1).alias("one")), "problem", "left").select("problem", F.when(F.col("one") == 1, 2).otherwise(F.col("methods")).cast("long").alias("methods"))
