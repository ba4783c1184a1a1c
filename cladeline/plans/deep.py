"""Queries over trees that are worked out as rows: a chain of all parts with suppliers as legs, and the tree of the other queries.

The SQL of the chain goes along it node by node, in recursion; the queries go by stretches of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import RateMixture, discrete_gamma, jukes_cantor
from ..operators import decompose
from ..operators.path_pruning import PathPruning
from . import derive, sql
from .catalog import _TREE_SQL, GAMMA4, GTR, UPPER, _inference, query
from .derive import kept, read

CHAIN_SITES, LEGS = 16, 1_000_000_000
MANY = discrete_gamma(0.7, 64)


# --- a chain as deep as there are parts

_CHAIN = f"""chain AS (SELECT p_partkey + 1 AS k, 0.0005::DOUBLE * (1 + p_partkey % 20) AS len FROM part),
legs AS (SELECT s_suppkey, (s_suppkey * 7919) % (SELECT count(*) FROM part) + 1 AS k, 0.02::DOUBLE + 0.001::DOUBLE * (s_suppkey % 10) AS len FROM supplier),
seen AS (SELECT l_orderkey % {CHAIN_SITES} AS site, l_partkey + 1 AS k, min(l_suppkey) % 4 AS b FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2),
legseen AS (SELECT l_orderkey % {CHAIN_SITES} AS site, l_suppkey, min(l_partkey) % 4 AS b FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2),
sites AS (SELECT DISTINCT site FROM (SELECT site FROM seen UNION ALL SELECT site FROM legseen)),
st(a) AS (VALUES (0), (1), (2), (3)),
leg AS (SELECT site, k, a, sum(ln(CASE WHEN a = b THEN 0.25 + 0.75 * exp(-4 * len / 3) ELSE 0.25 - 0.25 * exp(-4 * len / 3) END)) AS l
        FROM legseen JOIN legs USING (s_suppkey), st GROUP BY 1, 2, 3),
own AS MATERIALIZED (SELECT sites.site, chain.k, chain.len,
  exp(coalesce(max(leg.l) FILTER (leg.a = 0), 0)) * (CASE WHEN coalesce(max(b), 0) = 0 THEN 1 ELSE 0 END) AS e0, exp(coalesce(max(leg.l) FILTER (leg.a = 1), 0)) * (CASE WHEN coalesce(max(b), 1) = 1 THEN 1 ELSE 0 END) AS e1,
  exp(coalesce(max(leg.l) FILTER (leg.a = 2), 0)) * (CASE WHEN coalesce(max(b), 2) = 2 THEN 1 ELSE 0 END) AS e2, exp(coalesce(max(leg.l) FILTER (leg.a = 3), 0)) * (CASE WHEN coalesce(max(b), 3) = 3 THEN 1 ELSE 0 END) AS e3
  FROM sites CROSS JOIN chain LEFT JOIN seen ON seen.site = sites.site AND seen.k = chain.k LEFT JOIN leg ON leg.site = sites.site AND leg.k = chain.k GROUP BY 1, 2, 3),
up AS (SELECT site, (SELECT max(k) FROM chain) + 1 AS k, 1::DOUBLE AS m0, 1::DOUBLE AS m1, 1::DOUBLE AS m2, 1::DOUBLE AS m3, 0::DOUBLE AS ls FROM sites
  UNION ALL SELECT site, k, (d + x * v0) / t, (d + x * v1) / t, (d + x * v2) / t, (d + x * v3) / t, ls + ln(t)
  FROM (SELECT *, v0 + v1 + v2 + v3 AS t, (0.25 - 0.25 * x) * (v0 + v1 + v2 + v3) AS d
        FROM (SELECT up.site, own.k, e0 * m0 AS v0, e1 * m1 AS v1, e2 * m2 AS v2, e3 * m3 AS v3, exp(-4 * len / 3) AS x, ls FROM up JOIN own ON own.site = up.site AND own.k = up.k - 1)))"""
_CHAIN = _CHAIN.replace("l_suppkey, min(l_partkey)", "l_suppkey AS s_suppkey, min(l_partkey)")


def chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, observations): part k under part k - 1, the first under node 0, and each supplier under some part."""
    parts, suppliers = read(spark, d, "part"), read(spark, d, "supplier")
    n = parts.count()
    top = spark.range(1).select(F.col("id").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0.0).alias("branch_length"))
    spine = parts.select((F.col("p_partkey") + 1).cast("long"), F.col("p_partkey").cast("long"), 0.0005 * (1 + F.col("p_partkey") % 20))
    legs = suppliers.select((LEGS + F.col("s_suppkey")).cast("long"), ((F.col("s_suppkey") * 7919) % n + 1).cast("long"), 0.02 + 0.001 * (F.col("s_suppkey") % 10))
    lines = read(spark, d, "lineitem").where("l_quantity < 10")
    site = (F.col("l_orderkey") % CHAIN_SITES).alias("site")
    bit = lambda c: F.call_function("shiftleft", F.lit(1), (F.min(c) % 4).cast("int")).alias("mask")
    seen = lines.groupBy(site, (F.col("l_partkey") + 1).alias("node_id")).agg(bit("l_suppkey"))
    seen = seen.unionByName(lines.groupBy(site, (LEGS + F.col("l_suppkey")).alias("node_id")).agg(bit("l_partkey")))
    return top.union(spine).union(legs), seen


def _chain_pruning(spark: SparkSession, d: str, stretch: int = 256) -> PathPruning:
    return PathPruning(*chain(spark, d), jukes_cantor(), None, kept(spark, "chain"), stretch)


@query(f"WITH RECURSIVE {_CHAIN} SELECT CAST(site AS BIGINT) AS site, round(ls + ln(0.25 * (m0 + m1 + m2 + m3)), 6) AS log_likelihood FROM up WHERE k = 1")
def deep_loglik(spark, d):
    """Sites of a tree as deep as there are parts, in two exchanges of rows and not one a level."""
    return _chain_pruning(spark, d).evaluate().select("site", F.round("log_likelihood", 6).alias("log_likelihood"))


@query(f"""WITH RECURSIVE {_CHAIN},
down AS (SELECT site, 0 AS k, 0.25::DOUBLE AS q0, 0.25::DOUBLE AS q1, 0.25::DOUBLE AS q2, 0.25::DOUBLE AS q3, 0.25::DOUBLE AS o0, 0.25::DOUBLE AS o1, 0.25::DOUBLE AS o2, 0.25::DOUBLE AS o3 FROM sites
  UNION ALL SELECT site, k, o0 * e0 / t, o1 * e1 / t, o2 * e2 / t, o3 * e3 / t, o0, o1, o2, o3 FROM (SELECT *, o0 * e0 + o1 * e1 + o2 * e2 + o3 * e3 AS t
    FROM (SELECT site, k, e0, e1, e2, e3, r + x * q0 AS o0, r + x * q1 AS o1, r + x * q2 AS o2, r + x * q3 AS o3
      FROM (SELECT down.site, own.k, e0, e1, e2, e3, q0, q1, q2, q3, exp(-4 * len / 3) AS x, (0.25 - 0.25 * exp(-4 * len / 3)) * (q0 + q1 + q2 + q3) AS r FROM down JOIN own ON own.site = down.site AND own.k = down.k + 1)))),
v AS (SELECT u.site, u.k, u.m0, u.m1, u.m2, u.m3, own.len, own.e0, own.e1, own.e2, own.e3 FROM up u JOIN own ON own.site = u.site AND own.k = u.k),
w AS (SELECT down.site, down.k, [q0 * m0, q1 * m1, q2 * m2, q3 * m3] AS j FROM down JOIN up ON up.site = down.site AND up.k = down.k + 1 WHERE down.k % 97 = 0)
SELECT CAST(site AS BIGINT) AS site, CAST(k AS BIGINT) AS node_id, CAST(s - 1 AS INTEGER) AS state, round(j[s] / list_sum(j), 6) AS p FROM w, range(1, 5) r(s)""")
def deep_marginals(spark, d):
    """Marginals of every 97th node of the chain at every site."""
    paths = _chain_pruning(spark, d)
    sites = paths.evaluate().select("site")
    wanted = paths.paths.nodes.where(f"node_id % 97 = 0 AND node_id < {LEGS}").select("node_id")
    return paths.node_marginals(sites.crossJoin(F.broadcast(wanted))).withColumn("p", F.round("p", 6))


@query("""WITH RECURSIVE c AS (SELECT p_partkey + 1 AS k, 0.0005::DOUBLE * (1 + p_partkey % 20) AS len FROM part), n AS (SELECT count(*) AS n FROM c)
SELECT CAST(k AS BIGINT) AS node_id, round(sum(len) OVER (ORDER BY k), 9) AS distance FROM c
UNION ALL SELECT 0, 0 UNION ALL SELECT 1000000000 + s_suppkey, round(x + 0.02 + 0.001 * (s_suppkey % 10), 9) FROM supplier, n, (SELECT k, sum(len) OVER (ORDER BY k) AS x FROM c) p WHERE p.k = (s_suppkey * 7919) % n + 1""")
def deep_distances(spark, d):
    """From the root to every node, by pointer doubling."""
    return decompose.root_distances(chain(spark, d)[0], kept(spark, "distances")).select("node_id", F.round("distance", 9).alias("distance"))


_HEADS = f"""t AS ({_TREE_SQL}), s AS (SELECT s_suppkey, s_nationkey AS n, s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) AS heavy FROM supplier),
ns AS (SELECT n_nationkey AS n, n_regionkey AS g, 1 + (SELECT count(*) FROM s WHERE s.n = n_nationkey) AS size FROM nation),
nh AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size DESC, n) = 1 AS heavy FROM ns),
gs AS (SELECT r_regionkey AS g, 1 + coalesce((SELECT sum(size) FROM ns WHERE ns.g = r_regionkey), 0) AS size FROM region),
gh AS (SELECT g, CASE WHEN row_number() OVER (ORDER BY size DESC, g) = 1 THEN 0 ELSE 1 + g END AS head FROM gs),
nhead AS (SELECT n, nh.g, CASE WHEN heavy THEN head ELSE 6 + n END AS head FROM nh JOIN gh USING (g)),
heads AS (SELECT 0 AS node_id, 0 AS head, NULL AS n, NULL AS g UNION ALL SELECT 1 + g, head, NULL, g FROM gh UNION ALL SELECT 6 + n, head, n, g FROM nhead
  UNION ALL SELECT 31 + s_suppkey, CASE WHEN heavy THEN head ELSE 31 + s_suppkey END, n, g FROM s JOIN nhead USING (n))"""


@query(f"WITH {_HEADS} SELECT CAST(node_id AS BIGINT) AS node_id, CAST(head AS BIGINT) AS path, CAST(CASE WHEN head >= 31 THEN 0 WHEN node_id = head THEN 0 WHEN node_id >= 31 THEN 2 WHEN node_id >= 6 THEN 1 ELSE 0 END + CASE WHEN head = 0 AND node_id > 0 THEN 1 ELSE 0 END - CASE WHEN head BETWEEN 6 AND 30 AND node_id >= 31 THEN 1 ELSE 0 END AS BIGINT) AS pos FROM heads")
def tree_paths(spark, d):
    """Heavy paths of the tree of regions, nations and suppliers."""
    return decompose.heavy_paths(derive.tree_nodes(spark, d), kept(spark, "paths")).nodes.select("node_id", "path", "pos")


# --- marginals as rows, on the tree of the other queries


def _pruning(spark: SparkSession, d: str, model, mixture: RateMixture | None, name: str) -> PathPruning:
    return PathPruning(derive.tree_nodes(spark, d), derive.observations(spark, d), model, mixture, kept(spark, name))


def _upper(paths: PathPruning, least: int, most: int) -> DataFrame:
    nodes = paths.paths.nodes.where(F.col("node_id").between(least, most)).select("node_id")
    return paths.evaluate().select("site").crossJoin(F.broadcast(nodes))


@query(sql.node_marginals(GTR, GAMMA4))
def relational_marginals(spark, d):
    """node_marginals of the root, regions and nations, by messages along paths."""
    paths = _pruning(spark, d, GTR, GAMMA4, "marginals")
    return paths.node_marginals(_upper(paths, 0, 30)).withColumn("p", F.round("p", 6))


@query(sql.edge_marginals(GTR, GAMMA4))
def relational_edge_marginals(spark, d):
    paths = _pruning(spark, d, GTR, GAMMA4, "marginals")
    return paths.edge_marginals(_upper(paths, 1, 5)).withColumn("p", F.round("p", 6))


@query(sql.node_marginals(GTR, MANY))
def online_marginals(spark, d):
    """node_marginals under 64 rate categories, of which one at a time is held."""
    return _inference(spark, d, GTR, MANY).node_marginals(derive.sites(spark, d), UPPER, online=True).withColumn("p", F.round("p", 6))


# --- changed lengths


def _total_sql(more: str) -> str:
    """The sum of all sites' log-likelihoods if suppliers' edges are longer by ``more``."""
    message = lambda l, x: f"ln((0.25 - 0.25 * {x}) * total + {x} * exp({l} - t)) + t"
    return f"""(WITH o AS (SELECT site, node_id - 31 AS s, mask FROM ({{obs}})), st(a) AS (VALUES (0), (1), (2), (3)),
l1 AS (SELECT site, s_nationkey AS n, a, sum(ln(bit_count(mask) * (0.25 - 0.25 * x) + CASE WHEN (mask >> a) & 1 = 1 THEN x ELSE 0 END)) AS l
       FROM (SELECT o.*, s_nationkey, exp(-4 * (0.01 + 0.0001 * (s_suppkey % 1000) + {more}) / 3) AS x FROM o JOIN supplier ON s = s_suppkey), st GROUP BY 1, 2, 3),
l2 AS (SELECT l1.site, n_regionkey AS g, l1.a, sum({message("l", "exp(-4 * (0.02 + 0.01 * (n % 7)) / 3)")}) AS l
       FROM l1 JOIN (SELECT site, n, t, sum(exp(l - t)) AS total FROM l1 JOIN (SELECT site, n, max(l) AS t FROM l1 GROUP BY 1, 2) USING (site, n) GROUP BY 1, 2, 3) z USING (site, n) JOIN nation ON n = n_nationkey GROUP BY 1, 2, 3),
l3 AS (SELECT l2.site, l2.a, sum({message("l", "exp(-4 * (0.05 + 0.01 * g) / 3)")}) AS l
       FROM l2 JOIN (SELECT site, g, t, sum(exp(l - t)) AS total FROM l2 JOIN (SELECT site, g, max(l) AS t FROM l2 GROUP BY 1, 2) USING (site, g) GROUP BY 1, 2, 3) z USING (site, g) GROUP BY 1, 2)
SELECT round(sum(ll), 4) FROM (SELECT site, max(t) + ln(sum(0.25 * exp(l - t))) AS ll FROM l3 JOIN (SELECT site, max(l) AS t FROM l3 GROUP BY 1) USING (site) GROUP BY 1))"""


_OBS = "SELECT l_orderkey % 512 AS site, 31 + l_suppkey AS node_id, bit_or(CAST(1 << CAST(l_partkey % 4 AS INTEGER) AS INTEGER)) AS mask FROM lineitem GROUP BY 1, 2"


@query(f"""WITH {_HEADS}, dirty AS (SELECT DISTINCT x.head FROM heads x, heads y WHERE y.node_id >= 31 AND y.n = 7 AND (x.node_id = y.node_id OR x.node_id = 6 + y.n OR x.node_id = 1 + y.g OR x.node_id = 0)),
c AS (SELECT count(*) AS n FROM heads WHERE head IN (SELECT head FROM dirty))
SELECT 'all' AS turn, (SELECT count(*) FROM t) AS recomputed, {_total_sql("0").replace("{obs}", _OBS)} AS total
UNION ALL SELECT 'one nation', (SELECT n FROM c), {_total_sql("CASE WHEN s_nationkey = 7 THEN 0.05 ELSE 0 END").replace("{obs}", _OBS)}
UNION ALL SELECT 'as before', 0, {_total_sql("0").replace("{obs}", _OBS)}""")
def partial_update(spark, d):
    """Longer edges of one nation's suppliers, then the old ones again: nodes worked out, and the totals."""
    paths = _pruning(spark, d, jukes_cantor(), None, "partial")
    old = derive.tree_nodes(spark, d).join(read(spark, d, "supplier").where("s_nationkey = 7").select((31 + F.col("s_suppkey")).alias("node_id")), "node_id")
    rows = []
    for turn, lengths in (("all", None), ("one nation", old.withColumn("branch_length", F.col("branch_length") + 0.05)), ("as before", old)):
        scored = paths.evaluate(None if lengths is None else lengths.select("node_id", "branch_length"))
        rows.append(scored.agg(F.lit(turn).alias("turn"), F.lit(paths.recomputed["nodes"]).cast("long").alias("recomputed"), F.round(F.sum("log_likelihood"), 4).alias("total")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
