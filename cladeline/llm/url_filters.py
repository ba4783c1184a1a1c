"""URL filters by a sort-merge range join over reversed-host keys.

``www.example.com`` becomes the key ``com.example.www.``.  All hosts that a rule host covers are then
the keys in the interval [``com.example.``, ``com.example/``), and intervals of different rules either
nest or are disjoint.  Keys of pages and both ends of every interval are sorted together; a running
window sweeps over them and holds the stack of the rules that are open.  A page tests the paths of the
rules on its stack and takes the longest.

Each sweep lane gets a share of the pages, about LANE_ROWS, dealt by row number and so even whatever the hosts are, and
a copy of the interval ends.  Rules are swept SWEEP_RULES at a time, so that a lane's copy stays small however many there are;
the best rule of one sweep meets that of the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions, table

SWEEP_RULES, LANE_ROWS = 10_000, 1_000_000

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_events(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> tuple[DataFrame, int]:
    """Both ends of each rule host's interval, and how deep intervals nest."""
    by_key: dict[str, list[tuple[str, str, str, int]]] = {}
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        if action not in ("allow", "block") or not host or not slash:
            raise ValueError(f"a rule is allow or block, and host/path: {action} {rule}")
        key = ".".join(reversed(host.split("."))) + "."
        by_key.setdefault(key, []).append((slash + path, rule, action, len(rule)))
    events, stack, deepest = [], [], 0
    for key in sorted(by_key, key=lambda k: k.encode()):
        while stack and not key.startswith(stack[-1]):
            stack.pop()
        stack.append(key)
        deepest = max(deepest, len(stack))
        events += [(key, 1, 1, len(stack), by_key[key]), (key[:-1] + "/", 0, -1, 0, [])]
    rule_type = "array<struct<path:string,rule:string,action:string,length:int>>"
    schema = f"key string, ord int, delta int, level int, opened {rule_type}"
    return spark.createDataFrame(events, schema), deepest


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A null url or one without ``://`` has an empty host and path, fits no rule and gets ``default``;
    so does a url that no rule fits.  Of rules that fit, the longest string wins; of equally long ones
    the smaller string, then ``allow``.  Repeated rows are judged alike and all stay.  Columns of
    ``pages`` named like a result are replaced; others are kept.  An empty table gives an empty one.
    """
    spark = pages.sparkSession
    lanes = max(partitions(spark), pages.count() // LANE_ROWS)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    swept = pages.select(
        host_key(host_of(url)).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int").alias("lane"),
        F.lit(None).cast("struct<n:int,rule:string,action:string>").alias("best"),
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("item"),
    )
    for a in range(0, len(rules), SWEEP_RULES):
        swept = _sweep(swept, *rule_events(spark, rules[a : a + SWEEP_RULES]), lanes)
    return swept.select(
        *[F.col("item").getField(c).alias(c) for c in kept],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )


def _sweep(urls: DataFrame, events: DataFrame, deepest: int, lanes: int) -> DataFrame:
    """urls with the better of ``best`` and the best of these rules."""
    held = ["host", "path", "best", "item"]
    opened = events.schema["opened"].dataType
    rows = urls.select("key", F.lit(2).alias("ord"), F.lit(0).alias("delta"), F.lit(0).alias("level"), F.lit(None).cast(opened).alias("opened"), "lane", *held)
    ends = events.select(
        "key", "ord", "delta", "level", "opened",
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        *[F.lit(None).cast(urls.schema[c].dataType).alias(c) for c in held],
    )
    over = W.partitionBy("lane").orderBy("key", "ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = rows.unionByName(ends).select(
        "key", "ord", "lane", *held,
        F.sum("delta").over(over).alias("depth"),
        *[F.last(F.when(F.col("level") == k, F.col("opened")), True).over(over).alias(f"open_{k}") for k in range(1, deepest + 1)],
    ).where("ord = 2")
    stack = [F.when(F.col("depth") >= k, F.col(f"open_{k}")) for k in range(1, deepest + 1)]
    fits = F.filter(F.flatten(F.array_compact(F.array(*stack))), lambda r: F.startswith(F.col("path"), r["path"]))
    here = F.array_min(F.transform(fits, lambda r: F.struct((-r["length"]).alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return swept.select("key", "lane", "host", "path", F.least("best", here).alias("best"), "item")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rule_host, rule_path, rule) AS (VALUES
  ('allow', 'com', '/', 'com/'),
  ('block', 'example.com', '/en/', 'example.com/en/'),
  ('allow', 'www.example.com', '/en/', 'www.example.com/en/'),
  ('block', 'net', '/es/', 'net/es/'),
  ('block', 'net', '/fr/', 'net/fr/'))
SELECT page_id, host, path,
       (SELECT max_by(rule, length(rule)) FROM r
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT max_by(action, length(rule)) FROM r
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM u
"""
