"""Queries over logs that are made from line items, orders and events: strict scans, gates, summaries, what is printed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import corpus, encode, report, runs
from ..streaming.streams import folder, render_available
from .catalog import _BEST, _COVER, _medians, _small, query
from .derive import kept, read

# --- a log of measurements under changing headers

_NATIVE = "backend,precision,dataset,site_batch,unique_patterns,measured_total_ms,max_abs_error,max_relative_error,state_mismatches"
_BASE = "baseline,precision,dataset,site_batch,unique_patterns,resource,threads,base_total_ms,max_abs_error,max_relative_error"
_OFF = "backend,task,cpu"
#: Line items once each: order o, number n, part p, supplier s, quantity q, flag.
_ITEM_SQL = "SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS INTEGER) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2"


def _items(spark, d) -> DataFrame:
    keys = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return keys.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("flag"))


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _lines(spark, d) -> DataFrame:
    """file, line_no, line: items under the header of the last order that has one; every item of an even part is native.

    One exchange, by order: an order's first item also brings the order's header and note.
    """
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").repartition("o")
    x = lines.groupBy("o", "n").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("flag"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    batch = F.call_function("shiftleft", F.lit(1), n)
    abs_error = F.when(q == 49, "nan").otherwise(_text(q, "e-9"))
    time = F.when(q == 50, "0").otherwise(q.cast("string"))
    native = _text("cuda,", F.when(n % 2 == 0, "FP32").otherwise("FP64"), ',"set,', s, '",', batch, ",128,", time, ",", abs_error, ",", q, F.when(n % 2 == 0, "e-4").otherwise("e-12"), ",", F.when((n == 6) & (s % 5 == 0), 1).otherwise(0))
    base = _text("ext,FP64,set-", s, ",", batch, ",128,", F.when(F.col("flag") == "A", "cuda").otherwise("cpu"), ",", n, ",", time, ",", abs_error, ",", q, "e-12")
    head = F.when(F.col("o") % 7 == 0, _NATIVE).when(F.col("o") % 7 == 3, _BASE).when(F.col("o") % 7 == 5, _OFF)
    x = x.withColumn("opens", F.row_number().over(W.partitionBy("o").orderBy("n")) == 1)
    opens = F.col("opens")
    row = lambda at, line: F.struct((F.col("o") * 10 + at).alias("line_no"), line.alias("line"))
    found = F.array(row(n, F.when(F.col("p") % 2 == 0, native).otherwise(base)), row(F.lit(0), F.when(opens, head)), row(F.lit(9), F.when(opens & (F.col("o") % 3 == 0), F.lit("# a, note"))))
    return x.select(_text("log", F.col("o") % 4).alias("file"), F.explode(F.filter(found, lambda r: r["line"].isNotNull())).alias("r")).select("file", "r.line_no", "r.line")


_SCAN_SQL = f"""WITH x AS ({_ITEM_SQL}),
l AS (SELECT 'log' || (o % 4) AS file, o * 10 + n AS line_no, CASE WHEN p % 2 = 0 THEN 9 ELSE 10 END AS kind, NULL AS head, n, s, q, flag FROM x
      UNION ALL SELECT DISTINCT 'log' || (o % 4), o * 10, NULL, CASE o % 7 WHEN 0 THEN 9 WHEN 3 THEN 10 ELSE 0 END, NULL, NULL, NULL, NULL FROM x WHERE o % 7 IN (0, 3, 5)),
h AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS now FROM l),
r AS (SELECT *, CASE WHEN kind <> now THEN 'wrong number of fields' WHEN q = 49 THEN 'not finite: max_abs_error' WHEN q = 50 THEN 'elapsed time not positive' END AS reason FROM h WHERE kind IS NOT NULL AND now > 0)"""

_DEFAULTS = {"benchmark_mode": "fixed-model", "study": "standard"}
_ELAPSED = ["measured_total_ms", "base_total_ms"]


def _scan(spark, d) -> tuple[DataFrame, DataFrame]:
    return report.log_records(_lines(spark, d), ["cuda", "ext"], ["backend", "baseline"], _ELAPSED, _DEFAULTS, ["precision", "dataset", "site_batch", "unique_patterns", "study"], ["max_abs_error", "max_relative_error"], store=kept(spark, "log"))


@query(f"""{_SCAN_SQL} SELECT file, CAST(line_no AS BIGINT) AS line_no, CASE WHEN kind = 9 THEN 'set,' ELSE 'set-' END || s AS dataset,
CASE WHEN kind = 9 THEN 'cuda' WHEN flag = 'A' THEN 'ext_cuda' ELSE 'ext_cpu_' || n || 't' END AS method, CASE WHEN kind = 9 THEN 'cuda' WHEN flag = 'A' THEN 'ext-cuda' ELSE 'ext-cpu' END AS coarse,
CAST(q AS DOUBLE) AS total, 'standard' AS study, CASE WHEN n = 7 THEN 'complete-alignment-wall-time' ELSE 'sum-of-per-chunk-resident-calls' END AS scope FROM r WHERE reason IS NULL""")
def log_scan(spark, d):
    f = F.col("fields")
    method = report.method_id(f["backend"], f["baseline"], f["resource"], f["threads"])
    return _scan(spark, d)[0].select(
        "file", "line_no", f["dataset"].alias("dataset"), method.alias("method"), report.coarse_method(method).alias("coarse"), report.elapsed(f, _ELAPSED).alias("total"),
        f["study"].alias("study"), report.measurement_scope(f["benchmark_mode"], f["site_batch"], f["unique_patterns"]).alias("scope"),
    )


@query(f"{_SCAN_SQL} SELECT file, CAST(line_no AS BIGINT) AS line_no, reason FROM r WHERE reason IS NOT NULL")
def log_rejects(spark, d):
    return _scan(spark, d)[1]


@query(f"{_SCAN_SQL} SELECT file, count(*) AS records FROM r WHERE reason IS NULL GROUP BY 1")
def log_files(spark, d):
    """Logs written as folders of part files, read back by splits and scanned as one: their union, told apart by where they come from."""
    path = folder(spark, "logs")
    _lines(spark, d).repartitionByRange(8, "file", "line_no").sortWithinPartitions("file", "line_no").select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    found = report.numbered_lines(spark, path, F.regexp_extract("file", "file=([a-z0-9]+)", 1))
    records, _ = report.log_records(found, ["cuda", "ext"], ["backend", "baseline"], _ELAPSED, _DEFAULTS, [], ["max_abs_error"])
    return records.groupBy("file").agg(F.count("*").alias("records"))


@query(f"{_SCAN_SQL} SELECT dataset, precision, method, count(*) AS n FROM (SELECT 'set-' || s AS dataset, 'FP64' AS precision, 'ext_cuda' AS method FROM r WHERE reason IS NULL AND kind = 10 AND flag = 'A') WHERE dataset LIKE 'set-1%' GROUP BY 1, 2, 3")
def report_filters(spark, d):
    f = F.col("fields")
    rows = _scan(spark, d)[0].select(f["dataset"].alias("dataset"), f["precision"].alias("precision"), report.method_id(f["backend"], f["baseline"], f["resource"], f["threads"]).alias("method"))
    return report.select_records(rows, "set-1", precision=["FP64"], method="ext_cuda").groupBy("dataset", "precision", "method").agg(F.count("*").alias("n"))


def _sections() -> dict:
    f = F.col("fields")
    return {"native": f["backend"] == "cuda", "external": f["baseline"] == "ext", "fish": f["dataset"] == "fish"}


@query(f"{_SCAN_SQL} SELECT 'native' AS section, CAST(count_if(kind = 9) AS BIGINT) AS n FROM r WHERE reason IS NULL UNION ALL SELECT 'external', CAST(count_if(kind = 10) AS BIGINT) FROM r WHERE reason IS NULL UNION ALL SELECT 'fish', 0")
def section_counts(spark, d):
    return report.section_counts(_scan(spark, d)[0], _sections())


@query(f"""{_SCAN_SQL}, g AS (SELECT * FROM r WHERE reason IS NULL)
SELECT 'normalised error above the limit' AS fault, file || ':' || line_no AS what FROM g WHERE kind = 9 AND n % 2 = 0 AND q > 20
UNION ALL SELECT 'states differ', file || ':' || line_no FROM g WHERE kind = 9 AND n = 6 AND s % 5 = 0 AND q <= 20
UNION ALL SELECT 'a limit without a smaller success', 'set-' || s_suppkey || ' FP64' FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey NOT IN (SELECT s FROM g WHERE kind = 10 AND n = 1)
UNION ALL SELECT 'a section without records', 'fish' UNION ALL SELECT 'a section is not complete', 'external FP64'""")
def whole_log_gate(spark, d):
    """Every row's errors and states, every limit's evidence, every section's rows and end."""
    limits = read(spark, d, "supplier").where("s_suppkey % 4 = 0").select(_text("set-", F.col("s_suppkey")).alias("dataset"), F.lit("FP64").alias("precision"), F.lit(4).alias("first_infeasible"))
    done = _small(spark, [("native", "FP32"), ("native", "FP64")], "section string, precision string")
    return report.gate_faults(_scan(spark, d)[0], limits, done, ["dataset", "precision"], _sections(), [("native", "FP32"), ("external", "FP64")])


# --- a log of tasks

_TASK = "backend,benchmark_mode,task,repeats,cpu_ms,accelerator_ms,cpu_over_accelerator,max_abs_error,max_relative_error,state_mismatches,cpu_samples_ms,accelerator_samples_ms"
_TASK_BAD = ["invalid mode", "invalid task", "invalid numeric field", "timing fields must be positive", "correctness fields must not be negative", "the ratio is not that of the times", "timing samples must be finite and positive", "as many timing samples as repeats"]
_TASK_SQL = f"SELECT o, n, p % 16 AS k, q, flag FROM ({_ITEM_SQL}) WHERE n <= 2"


def _task_lines(spark, d) -> DataFrame:
    x = _items(spark, d).where("n <= 2")
    k, q = F.col("p") % 16, F.col("q")
    bad = lambda at, wrong, right: F.when(k == at, wrong).otherwise(right)
    task = F.when(F.col("flag") == "A", "likelihood").when(F.col("flag") == "N", "joint-map").otherwise("all-marginals")
    line = _text(
        "cuda,", bad(0, "no-update", F.lit("fixed-model")), ",", bad(1, "guess", task), ",", bad(2, "x", F.lit("2")), ",", bad(3, "0", (4 * q).cast("string")), ",4,", bad(5, (q + 1).cast("string"), q.cast("string")), ",", bad(4, "-1", F.lit("0")), ",",
        q, "e-6,0,", bad(6, "1|-1", bad(7, "1|2|3", F.lit("1|2"))), ",4|4.5",
    )
    rows = x.select(F.lit("tasks").alias("file"), (F.col("o") * 10 + F.col("n")).alias("line_no"), line.alias("line"))
    more = _small(spark, [("tasks", -1, _TASK), ("tasks", -2, "cuda,before,any,header"), ("twice", 1, "backend,task,task"), ("fewer", 1, "backend,task"), ("fewer", 2, "cuda,likelihood")], "file string, line_no long, line string")
    return rows.unionByName(more)


def _task_scan(spark, d) -> tuple[DataFrame, DataFrame]:
    return report.log_records(_task_lines(spark, d), ["cuda"], ["backend", "baseline"], _TASK.split(","), {"gamma_shape": "none"}, every=True, store=kept(spark, "tasks"))


@query(f"SELECT 'tasks' AS file, CAST(o * 10 + n AS BIGINT) AS line_no, [{', '.join(repr(x) for x in _TASK_BAD)}][CAST(k + 1 AS INTEGER)] AS fault FROM ({_TASK_SQL}) WHERE k < 8 UNION ALL SELECT 'twice', 1, 'a column occurs twice'")
def task_faults(spark, d):
    records, rejects = _task_scan(spark, d)
    return report.task_faults(records).unionByName(rejects.withColumnRenamed("reason", "fault"))


@query(f"""SELECT 'cuda' AS backend, CASE flag WHEN 'A' THEN 'likelihood' WHEN 'N' THEN 'joint-map' ELSE 'all-marginals' END AS task, 'none' AS gamma_shape, count(*) AS problems, round(median(q), 6) AS median_speedup,
CAST(min(q) AS DOUBLE) AS minimum_speedup, CAST(max(q) AS DOUBLE) AS maximum_speedup, round(max(q) * 1e-6, 9) AS max_relative_error, CAST(0 AS BIGINT) AS state_mismatches FROM ({_TASK_SQL}) WHERE k >= 8 GROUP BY flag""")
def task_summary(spark, d):
    records, _ = _task_scan(spark, d)
    fine = records.join(report.task_faults(records), ["file", "line_no"], "left_anti")
    out = report.task_summary(fine, ["backend", "task", "gamma_shape"])
    return out.drop("max_abs_error").withColumn("median_speedup", F.round("median_speedup", 6)).withColumn("max_relative_error", F.round("max_relative_error", 9))


# --- declarations, markers, blocks

_STUDY_SQL = """WITH o AS (SELECT DISTINCT 'f' || (l_orderkey % 3) AS file, l_orderkey AS o FROM lineitem),
w AS (SELECT file, o, last_value(CASE WHEN o % 10 = 0 THEN 'S' || (o // 10 % 4) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY o) AS study FROM o),
decl AS (SELECT DISTINCT file, study, 'k' || (o % 5) AS key, 'v=' || (o % 7 // 5) AS value FROM w WHERE study IS NOT NULL AND o % 10 BETWEEN 1 AND 6)"""


def _declared(spark, d) -> DataFrame:
    o = F.col("o")
    line = F.when(o % 10 == 0, _text("# study=S", F.expr("o div 10 % 4"))).when((o % 10).between(1, 6), _text("# k", o % 5, "=v=", F.expr("o % 7 div 5"))).otherwise("# an aside, k1 = none")
    return report.declarations(_items(spark, d).select("o").distinct().select(_text("f", o % 3).alias("file"), o.alias("line_no"), line.alias("line")))


@query(f"{_STUDY_SQL} SELECT file, study, key, value FROM decl")
def study_declarations(spark, d):
    return _declared(spark, d)


@query(f"{_STUDY_SQL} SELECT file, study, key, count(DISTINCT value) AS n_values FROM decl GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1")
def study_conflicts(spark, d):
    return report.conflicts(_declared(spark, d), ["file", "study", "key"], "value")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS line_no, 'ext-cpu' AS method, CAST(s_suppkey AS VARCHAR) AS threads, 'a set, no ' || s_suppkey AS dataset, CASE WHEN s_suppkey % 2 = 0 THEN 'b=c' ELSE '' END AS note,
'ext_cpu_' || s_suppkey || 't' AS exact FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey > 0""")
def capacity_markers(spark, d):
    """Markers with quoted values, repeated keys (the last counts) and words that are no pairs."""
    s = F.col("s_suppkey")
    line = _text(F.when(s % 3 == 0, "# other ").otherwise("# capacity_limit "), "method=first method=ext-cpu alone threads=", s, ' dataset="a set, no ', s, '" note=', F.when(s % 2 == 0, "'b=c'").otherwise(""))
    rows = report.markers(read(spark, d, "supplier").where(s > 0).select(F.lit("a").alias("file"), s.alias("line_no"), line.alias("line")), "capacity_limit")
    p = F.col("pairs")
    return rows.select("line_no", p["method"].alias("method"), p["threads"].alias("threads"), p["dataset"].alias("dataset"), p["note"].alias("note"), report.capacity_method(p["method"], p["threads"]).alias("exact"))


_BLOCK_SQL = """WITH s AS (SELECT 'u' || (user_id % 20) AS file, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS session FROM events),
b AS (SELECT file, session, min(CASE WHEN event_type = 'signup' THEN event_id END) AS opened, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS closed, count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 3 END) AS declared FROM s WHERE session > 0 GROUP BY 1, 2)"""


def _blocks(spark, d) -> tuple[DataFrame, DataFrame]:
    e, kind = F.col("event_id"), F.col("event_type")
    line = F.when(kind == "signup", _text("# driver=d", e)).when(kind == "purchase", _text("# progress total=", e, ' name="a b"')).when(kind == "click", _text("# k", e % 3, "=", e)).otherwise("row,of,data")
    return runs.protocol_blocks(read(spark, d, "events").select(_text("u", F.col("user_id") % 20).alias("file"), e.alias("line_no"), line.alias("line")), "driver")


@query(f"{_BLOCK_SQL} SELECT file, CAST(session AS BIGINT) AS session, 'd' || opened AS opened, CAST(closed AS VARCHAR) AS total, 'a b' AS name, CAST(declared + 3 AS INTEGER) AS pairs FROM b WHERE closed IS NOT NULL")
def protocol_blocks(spark, d):
    p = F.col("pairs")
    return _blocks(spark, d)[0].select("file", "session", "opened", p["total"].alias("total"), p["name"].alias("name"), F.size(p).alias("pairs"))


@query(f"{_BLOCK_SQL} SELECT file, CAST(session AS BIGINT) AS session, 'a block is not closed' AS fault FROM b WHERE closed IS NULL")
def protocol_faults(spark, d):
    return _blocks(spark, d)[1]


# --- completeness, pairs, order


@query("""SELECT CAST(s AS BIGINT) AS problem, array_to_string(list_sort(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda x: x > 7)), ',') AS unknown, n > len(have) AS twice FROM (
SELECT o AS s, list_distinct(list(CAST(l AS INTEGER))) AS have, count(*) AS n FROM (SELECT l_orderkey % 400 AS o, CASE WHEN l_partkey % 50 = 0 THEN 9 ELSE l_linenumber END AS l FROM lineitem) GROUP BY 1)
WHERE n > len(have) OR len(list_filter(have, lambda x: x > 7)) > 0 OR len(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(have, x))) > 0""")
def completeness(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 400).alias("problem"), F.when(F.col("l_partkey") % 50 == 0, 9).otherwise(F.col("l_linenumber")).alias("batch"))
    out = runs.completeness(rows, ["problem"], "batch", list(range(1, 8)))
    listed = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return out.select("problem", listed("missing"), listed("unknown"), "twice")


@query("SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem")
def distinct_protocols(spark, d):
    return runs.distinct_protocols(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")), ["flag", "status"])


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 3 GROUP BY 1")
def one_protocol(spark, d):
    """Rows of one protocol pass; of several, the job would fail."""
    rows = read(spark, d, "lineitem").where("l_returnflag = 'A' AND l_linenumber = 3")
    return runs.one_protocol(rows, ["l_returnflag", "l_linenumber"]).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("""SELECT flag, CAST(n AS BIGINT) AS protocols, n = 1 AS agrees FROM (SELECT l_returnflag AS flag, count(DISTINCT (l_linestatus, l_linenumber % 2)) AS n FROM lineitem GROUP BY 1)""")
def protocol_agreement(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_linenumber") % 2).alias("half"))
    return runs.agreement(rows, ["flag"], ["status", "half"])


@query(f"""WITH c AS (SELECT method, problem, problem % 3 AS shape FROM ({_COVER}) UNION ALL SELECT 'A', problem, problem % 3 + (problem % 2) FROM ({_COVER}) WHERE method = 'A' AND problem % 5 = 0),
g AS (SELECT problem, count_if(method = 'A') AS a, count_if(method = 'R') AS r, count(DISTINCT shape) AS k FROM c WHERE method IN ('A', 'R') GROUP BY 1)
SELECT CAST(problem AS BIGINT) AS problem, 'A is missing' AS fault FROM g WHERE a = 0 UNION ALL SELECT problem, 'R is missing' FROM g WHERE r = 0 UNION ALL SELECT problem, 'A occurs twice' FROM g WHERE a > 1 UNION ALL SELECT problem, 'shape differs' FROM g WHERE k > 1""")
def pair_faults(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("problem")).distinct().where("(problem % 7 <> 0 OR method <> 'R') AND (problem % 11 <> 0 OR method <> 'A')").withColumn("shape", F.col("problem") % 3)
    again = rows.where("method = 'A' AND problem % 5 = 0").withColumn("shape", F.col("problem") % 3 + F.col("problem") % 2)
    return report.pair_faults(rows.unionByName(again), ["problem"], "method", "A", "R", ["shape"])


@query(f"SELECT CAST(o AS BIGINT) AS o, CAST(n AS INTEGER) AS n FROM (SELECT o, n, p, lag(p) OVER (PARTITION BY o ORDER BY n) AS before FROM ({_ITEM_SQL})) WHERE before >= p")
def not_rising(spark, d):
    return report.not_rising(_items(spark, d), ["o"], "n", "p").select("o", "n")


@query("SELECT 'case' AS variant, count(*) AS left_over FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'dataset', count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 48) UNION ALL SELECT 'dataset-batch', count(*) FROM (SELECT s_suppkey, CAST(b AS INTEGER) FROM supplier, range(1, 8) r(b) EXCEPT SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'replicate', count(*) FROM (SELECT s_suppkey, f, CAST(b AS INTEGER) FROM supplier, (VALUES ('A'), ('N'), ('R')) v(f), range(1, 8) r(b) EXCEPT SELECT l_suppkey, l_returnflag, l_linenumber FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'task', count(*) FROM (SELECT s_suppkey, f FROM supplier, (VALUES ('A'), ('N'), ('R'), ('X')) v(f) EXCEPT SELECT l_suppkey, l_returnflag FROM lineitem)")
def resume_variants(spark, d):
    """What is left to do by each of the keys that runs are resumed by."""
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("dataset"), F.col("l_linenumber").alias("batch"), F.col("l_returnflag").alias("task"), "l_quantity")
    sets = read(spark, d, "supplier").select(F.col("s_suppkey").alias("dataset"))
    batches, tasks = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("batch"), lambda *t: F.explode(F.array(*map(F.lit, t))).alias("task")
    plans = {
        "case": (read(spark, d, "orders").select(F.col("o_orderkey").alias("case")), items, ["case"]),
        "dataset": (sets, items.where("l_quantity > 48"), ["dataset"]),
        "dataset-batch": (sets.select("dataset", batches), items.where("l_quantity > 45"), ["dataset", "batch"]),
        "replicate": (sets.select("dataset", batches).select("*", tasks("A", "N", "R")), items.where("l_quantity > 45"), ["dataset", "batch", "task"]),
        "task": (sets.select("dataset", tasks("A", "N", "R", "X")), items, ["dataset", "task"]),
    }
    out = None
    for name, (planned, done, key) in plans.items():
        row = report.to_resume(planned, done, key).distinct().agg(F.lit(name).alias("variant"), F.count("*").alias("left_over"))
        out = row if out is None else out.unionByName(row)
    return out


# --- what is printed and written

_PRINT_SQL = f"SELECT method, problem, batch, CAST(CAST(floor(median_elapsed) AS BIGINT) AS VARCHAR) AS t, 'x,\"' || problem || '\"' AS name FROM ({_BEST})"


@query(f"""SELECT CAST(1 AS BIGINT) AS line_no, '# study=a b' AS line UNION ALL SELECT 2, 'method,problem,batch,t,name'
UNION ALL SELECT row_number() OVER (ORDER BY method, problem, batch) + 2, method || ',' || problem || ',' || batch || ',' || t || ',"x,""' || problem || '""' || chr(34) FROM ({_PRINT_SQL})""")
def printed_best(spark, d):
    """The fastest batches as they are written: metadata, header, rows in the order of their keys, cells quoted."""
    best = report.best_batch(_medians(spark, d), ["method", "problem"], "median_elapsed", "batch")
    rows = best.select("method", "problem", "batch", F.floor("median_elapsed").cast("long").alias("t"), _text('x,"', F.col("problem"), '"').alias("name"))
    return report.printed(rows, ["method", "problem", "batch", "t", "name"], ["method", "problem", "batch"], {"study": "a\nb"})


@query(f"SELECT method, CAST(problem AS BIGINT) AS problem, CAST(batch AS BIGINT) AS batch FROM ({_BEST})")
def written_report(spark, d):
    best = report.best_batch(_medians(spark, d), ["method", "problem"], "median_elapsed", "batch").select("method", "problem", "batch")
    path = folder(spark, "report")
    corpus.write_csv(best, path)
    return spark.read.option("header", True).csv(path).select("method", F.col("problem").cast("long"), F.col("batch").cast("long"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS line_no, 'key_' || n_nationkey || '=' || n_name || ' a nation' AS line FROM nation")
def written_metadata(spark, d):
    path = folder(spark, "metadata")
    corpus.write_metadata_rows(read(spark, d, "nation").select("n_nationkey", _text("key_", F.col("n_nationkey")).alias("key"), _text(F.col("n_name"), "\na nation").alias("value")), ["n_nationkey"], path)
    lines = report.numbered_lines(spark, path, F.lit("metadata"))
    return lines.where("line <> ''").select((F.col("line_no") - 1).cast("long").alias("line_no"), "line")


_RANKED_SQL = "r AS (SELECT doc_id, n_chars, sha256('cladeline-rank' || chr(0) || CAST(doc_id AS VARCHAR)) AS rank FROM documents), fit AS (SELECT *, row_number() OVER (PARTITION BY n_chars >= 1000 ORDER BY rank) AS place FROM r WHERE doc_id % 17 <> 3 AND n_chars >= 100 AND n_chars < 4000)"


@query(f"""WITH {_RANKED_SQL} SELECT 'manifest' AS list, CAST(doc_id AS VARCHAR) AS doc_id, CAST(n_chars AS VARCHAR) AS n_chars FROM fit WHERE place <= 5
UNION ALL SELECT 'excluded', CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR) FROM r WHERE (doc_id % 17 = 3 OR n_chars < 100 OR n_chars >= 4000) AND rank <= (SELECT max(last) FROM (SELECT max(rank) AS last FROM fit WHERE place <= 5 GROUP BY n_chars >= 1000))
UNION ALL SELECT 'header', 'doc_id', 'n_chars'""")
def corpus_files(spark, d):
    """The manifest and the list of what was left out, written and read back; and the header of a list without rows."""
    from ..functions.randomness import stable_rank

    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    rank = stable_rank("cladeline-rank", F.col("doc_id").cast("string"))
    chosen, excluded, _ = corpus.stratified_with_exclusions(docs, F.col("n_chars"), [100, 1000, 4000], rank, 5, F.when(F.col("doc_id") % 17 == 3, "not fit"))
    path = folder(spark, "corpus")
    corpus.write_corpus(chosen, ["n_chars", "rank"], excluded, path)
    corpus.write_corpus(chosen.limit(0), ["n_chars", "rank"], excluded.limit(0), f"{path}-empty")
    lists = [spark.read.option("header", True).csv(f"{path}/{x}").select(F.lit(x).alias("list"), "doc_id", "n_chars") for x in ("manifest", "excluded")]
    head = spark.read.csv(f"{path}-empty/manifest").select(F.lit("header").alias("list"), F.col("_c0").alias("doc_id"), F.col("_c1").alias("n_chars"))
    return lists[0].unionByName(lists[1]).unionByName(head)


@query("""WITH r AS (SELECT doc_id, n_chars, sha256('cladeline-rank' || chr(0) || CAST(doc_id AS VARCHAR)) AS rank FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN doc_id % 17 = 3 THEN 'not fit' ELSE 'size=' || n_chars || ' lies outside [100, 4000)' END AS reason FROM r
WHERE (doc_id % 17 = 3 OR n_chars < 100 OR n_chars >= 4000) AND rank <= (SELECT max(last) FROM (SELECT max(rank) AS last, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY n_chars >= 1000 ORDER BY rank) AS place FROM r WHERE doc_id % 17 <> 3 AND n_chars >= 100 AND n_chars < 4000) WHERE place <= 5 GROUP BY n_chars >= 1000))""")
def stratified_exclusions(spark, d):
    from ..functions.randomness import stable_rank

    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    rank = stable_rank("cladeline-rank", F.col("doc_id").cast("string"))
    reason = F.when(F.col("doc_id") % 17 == 3, "not fit")
    return corpus.stratified_with_exclusions(docs, F.col("n_chars"), [100, 1000, 4000], rank, 5, reason)[1].select("doc_id", "reason")


@query("SELECT l_returnflag AS method, round(sum(l_quantity), 2) AS upload_ms, round(sum(l_extendedprice), 2) AS kernel_ms, round(sum(l_discount), 2) AS download_ms, round(sum(l_tax), 2) AS wall_ms, count(*) AS batches FROM lineitem GROUP BY 1")
def batch_timings(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("upload_ms"), F.col("l_extendedprice").alias("kernel_ms"), F.col("l_discount").alias("download_ms"), F.col("l_tax").alias("wall_ms"))
    out = report.batch_timings(rows, ["method"])
    return out.select("method", *[F.round(c, 2).alias(c) for c in ("upload_ms", "kernel_ms", "download_ms", "wall_ms")], "batches")


@query("SELECT l_returnflag AS flag, count(*) AS n, round(max(abs(l_tax - l_discount)), 6) AS max_abs, round(max(abs(l_tax - l_discount)), 6) AS max_rel, true AS checked FROM lineitem GROUP BY 1")
def correctness_gate(spark, d):
    """Fails the job beyond the threshold; here nothing is."""
    gap = F.abs(F.col("l_tax") - F.col("l_discount"))
    metrics = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.max(gap), 6).alias("max_abs"), F.round(F.max(gap), 6).alias("max_rel"))
    return report.gate(metrics.withColumn("state_mismatches", F.lit(0)), 0.5).drop("state_mismatches")


_SHOWN_SQL = """WITH e AS (SELECT event_id, event_type, user_id % 5 AS run, event_id % 50 + 1 AS now FROM events),
c AS (SELECT *, now * 10 // 50 AS bucket, now IN (1, 50) AS resets, sum(CASE WHEN now IN (1, 50) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY event_id) AS part FROM e WHERE event_type = 'click'),
p AS (SELECT *, max(bucket) OVER (PARTITION BY run, part ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT CAST(event_id AS BIGINT) AS line_no, 'progress' AS kind FROM p WHERE resets OR before IS NULL OR bucket > before
UNION ALL SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'milestone' ELSE 'heading' END FROM e WHERE event_type IN ('error', 'purchase', 'signup')"""


def _long_log(spark, d) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    line = F.when(kind == "error", _text("cuda error: no ", e)).when(kind == "purchase", _text("# benchmark_section_complete section=s", e)).when(kind == "signup", _text("=== ", e))
    line = line.when(kind == "click", _text("# progress method=m", F.col("user_id") % 5, " method=x", F.col("user_id") % 5, " case=", e % 50 + 1, "/50")).otherwise(_text("# progress case=", e, "/0"))
    return read(spark, d, "events").select(F.lit("log").alias("file"), e.alias("line_no"), line.alias("line"))


@query(_SHOWN_SQL)
def rendered_log(spark, d):
    """The lines of a long log that are worth showing: errors, milestones, headings, and progress by tenths, with its first and last."""
    return runs.rendered(_long_log(spark, d)).select("line_no", "kind")


@query(_SHOWN_SQL)
def rendered_stream(spark, d):
    """The same of lines that arrive in four files, with a restart between the second and the third."""
    arriving, shown, state = (folder(spark, f"live-{x}") for x in ("lines", "shown", "state"))
    lines = _long_log(spark, d)
    n = (lines.agg(F.max("line_no")).first()[0] or 0) + 1
    for k in range(4):
        lines.where(F.expr(f"line_no * 4 div {n}") == k).coalesce(1).write.mode("append").parquet(arriving)
        if k % 2:
            render_available(spark, arriving, shown, state)
    return spark.read.schema("line_no long, kind string").parquet(shown)


@query(f"SELECT CAST(o AS BIGINT) AS o, CAST(row_number() OVER (ORDER BY o) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT o FROM ({_ITEM_SQL}))")
def ranked_rows(spark, d):
    return encode.ranked(_items(spark, d).select("o").distinct(), ["o"], "place")
