"""Reports over measurements: logs, medians, best batches, pairs, coverage, designs and schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.lines import carry_forward, numbered_lines  # noqa: F401  numbered_lines is what scans begin with
from ..sources.store import Store
from .encode import ranked


def csv_fields(line: Column) -> Column:
    """Cells of a line of CSV; in double quotes a cell may hold commas, and a doubled quote stands for one."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = lambda c: F.regexp_replace(c.substr(F.lit(2), F.length(c) - 2), '""', '"')
    quoted = F.transform(cells, lambda c: F.when(c.rlike('^".*"$'), bare(c)).otherwise(c))
    return F.when(F.instr(line, '"') > 0, quoted).otherwise(F.split(line, ",", -1))


def number(fields: Column, name: str) -> Column:
    """A field as a double; null if it is missing or no number."""
    return fields[name].try_cast("double")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def log_records(
    lines: DataFrame,
    first_fields: Sequence[str],
    headers: Sequence[str],
    required: Sequence[str],
    defaults: dict[str, str],
    identity: Sequence[str] = (),
    finite: Sequence[str] = (),
    every: bool = False,
    store: Store | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of lines of CSV under changing headers.

    A header is a line whose first field is in ``headers`` and switches the schema of what follows; a header
    without one of the ``required`` columns (or, if ``every``, without all of them) switches reading off.  records have file,
    line_no and a map of fields with defaults filled in; rejects have file, line_no and the first reason: a header that
    names a column twice, a wrong number of fields, an ``identity`` column that is missing, a ``finite`` one that is no finite
    number, or an elapsed time (the first ``required`` column that is there, unless ``every``) that is not positive.
    With a ``store``, the lines and what they are found to be are each written there once, and both results read that.
    """
    rows = lines.where("line <> '' AND NOT startswith(line, '#')")
    rows = store.put(rows, "lines") if store else rows
    first = F.regexp_extract("line", r'^(?:"([^",]*)"|([^",]*))(?:,|$)', 0)
    is_header = F.regexp_replace(first, '[",]', "").isin(*headers)
    rows = carry_forward(rows, ["file"], "line_no", F.when(is_header, csv_fields(F.col("line"))), "header").withColumn("fields", csv_fields(F.col("line")))
    has = (lambda c: F.array_contains("header", c))
    wanted = F.forall(F.array(*map(F.lit, required)), has) if every else F.exists("header", lambda h: h.isin(*required))
    twice = F.size(F.array_distinct("header")) < F.size("header")
    rows = rows.where(F.col("header").isNotNull() & ((is_header & twice) | (~is_header & wanted & F.element_at("fields", 1).isin(*first_fields))))
    filled = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.create_map().cast("map<string,string>")
    good = ~twice & (F.size("fields") == F.size("header"))
    own = F.when(good, F.map_from_arrays("header", "fields"))
    rows = rows.withColumn("pairs", F.map_zip_with(own, filled, lambda k, a, b: F.coalesce(a, b)))
    lacking = F.filter(F.array(*map(F.lit, identity)).cast("array<string>"), lambda c: ~F.map_contains_key("pairs", c))
    unfit = F.filter(F.array(*map(F.lit, finite)).cast("array<string>"), lambda c: ~_finite(F.element_at("pairs", c).try_cast("double")))
    elapsed_ = elapsed(F.col("pairs"), required)
    rows = rows.withColumn(
        "reason",
        F.when(twice, "a column occurs twice")
        .when(~good, "wrong number of fields")
        .when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
        .when(F.size(unfit) > 0, F.concat(F.lit("not finite: "), F.array_join(unfit, ", ")))
        .when(F.lit(not every) & ~(_finite(elapsed_) & (elapsed_ > 0)), "elapsed time not positive"),
    )
    rows = rows.select("file", "line_no", F.when(F.col("reason").isNull(), F.col("pairs")).alias("pairs"), "reason")
    rows = store.put(rows, "scan") if store else rows
    return rows.where("reason IS NULL").select("file", "line_no", F.col("pairs").alias("fields")), rows.where("reason IS NOT NULL").select("file", "line_no", "reason")


def strict(records: DataFrame, rejects: DataFrame) -> DataFrame:
    """records; the first reject in the order of the log, or a log without records, is an error."""
    bad = rejects.orderBy("file", "line_no").first()
    if bad is not None:
        raise ValueError(f"{bad['file']}:{bad['line_no']}: {bad['reason']}")
    if records.isEmpty():
        raise ValueError("no records found")
    return records


def elapsed(fields: Column, names: Sequence[str]) -> Column:
    """The first of the named columns that a record has, as a double."""
    held = F.coalesce(*[F.element_at(fields, n) for n in names])
    return held.try_cast("double")


def marker_pairs(body: Column) -> Column:
    """``k=v`` tokens as a map, the last of a key; a value may be in single or double quotes, and tokens without = are passed over."""
    token = r"""(?:^|\s)([^\s='"]+)=("(?:[^"\\]|\\.)*"|'[^']*'|[^\s'"]*)(?=\s|$)"""
    keys = F.regexp_extract_all(body, F.lit(token), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(token), F.lit(2)), lambda v: F.when(v.rlike("""^(".*"|'.*')$"""), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(0), F.size(keys) - 1).alias("i")), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["k"]))
    return F.when(F.size(keys) > 0, F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))).otherwise(F.create_map().cast("map<string,string>"))


def markers(lines: DataFrame, event: str) -> DataFrame:
    """file, line_no, pairs of ``# event k=v ...`` lines."""
    body = F.regexp_extract("line", rf"^#\s*{event}\s+(.*)$", 1)
    return lines.withColumn("body", body).where("body <> ''").select("file", "line_no", marker_pairs(F.col("body")).alias("pairs"))


def declarations(lines: DataFrame) -> DataFrame:
    """file, study, key, value of ``# key=value`` lines under the last ``# study=`` line."""
    key, value = F.regexp_extract("line", r"^#\s*(\w+)=(.*)$", 1), F.regexp_extract("line", r"^#\s*\w+=(.*)$", 1)
    rows = lines.withColumn("key", key).withColumn("value", value).where("key <> ''")
    rows = carry_forward(rows, ["file"], "line_no", F.when(F.col("key") == "study", F.col("value")), "study")
    return rows.where("study IS NOT NULL AND key <> 'study'").select("file", "study", "key", "value").distinct()


def conflicts(declared: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups with more than one value."""
    return declared.groupBy(*by).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def sessions(rows: DataFrame, by: list[str], order: str, starts: Column) -> DataFrame:
    """Adds session: how many starts there are at or above the row, 0 before the first."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("session", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def median_rows(rows: DataFrame, by: list[str], elapsed: str, errors: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.median(elapsed).alias("median_elapsed"), *[F.max(e).alias(f"max_{e}") for e in errors], F.count("*").alias("n_rows"))


def best_batch(medians: DataFrame, by: list[str], elapsed: str, batch: str) -> DataFrame:
    """The fastest batch of each group; of equally fast ones the largest."""
    w = W.partitionBy(*by).orderBy(F.asc(elapsed), F.desc(batch))
    return medians.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def pair_faults(rows: DataFrame, key: list[str], method: str, left: str, right: str, alike: Sequence[str] = ()) -> DataFrame:
    """key, fault for each key of which a side is missing or occurs twice, or whose sides differ in an ``alike`` column."""
    both = rows.where(F.col(method).isin(left, right)).groupBy(*key)
    found = both.agg(
        *[F.count_if(F.col(method) == m).alias(f"n{i}") for i, m in enumerate((left, right))],
        *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"d{i}") for i, c in enumerate(alike)],
    )
    rules = [F.when(F.col(f"n{i}") == 0, F.lit(f"{m} is missing")) for i, m in enumerate((left, right))]
    rules += [F.when(F.col(f"n{i}") > 1, F.lit(f"{m} occurs twice")) for i, m in enumerate((left, right))]
    rules += [F.when(F.col(f"d{i}") > 1, F.lit(f"{c} differs")) for i, c in enumerate(alike)]
    return found.select(*key, F.explode(F.array_compact(F.array(*rules))).alias("fault"))


def paired(rows: DataFrame, key: list[str], method: str, left: str, right: str, value: str, strict: bool = False) -> DataFrame:
    """key, left and right value and right / left, one row a key.

    Keys of which a side is missing are left out; if ``strict``, they fail the job, and so does a side that occurs
    twice.  One shuffle: the sides meet as a group.
    """
    sides = rows.where(F.col(method).isin(left, right)).groupBy(*key)
    found = sides.agg(
        *[F.max(F.when(F.col(method) == m, F.col(value))).alias(f"{side}_value") for m, side in ((left, "left"), (right, "right"))],
        F.count_if(F.col(method) == left).alias("n_left"), F.count_if(F.col(method) == right).alias("n_right"),
    )
    once = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    name = F.concat_ws(" ", *[F.col(k).cast("string") for k in key])
    if strict:
        fine = F.when(once, True).otherwise(F.raise_error(F.concat(F.lit("no single pair: "), name)).cast("boolean"))
        found = found.where(fine)
    else:
        fine = F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), F.raise_error(F.concat(F.lit("a side occurs twice: "), name)).cast("boolean")).otherwise(once)
        found = found.where(fine)
    return found.select(*key, "left_value", "right_value").withColumn("ratio", F.col("right_value") / F.col("left_value"))


def unpaired(rows: DataFrame, key: list[str], method: str, left: str, right: str) -> DataFrame:
    """Keys that one method has and the other lacks, with the missing method."""
    a, b = (rows.where(F.col(method) == m).select(*key).distinct() for m in (left, right))
    return a.join(b, key, "left_anti").withColumn("missing", F.lit(right)).unionByName(b.join(a, key, "left_anti").withColumn("missing", F.lit(left)))


def ratio_summary(pairs: DataFrame, by: list[str], ratio: str = "ratio") -> DataFrame:
    r = F.col(ratio)
    return pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(r > 1).alias("wins"), F.min(r).alias("least"), F.median(r).alias("median"), F.percentile(r, 0.9).alias("p90"), F.max(r).alias("most"))


def check_edges(edges: Sequence[float], least: float = 0.0, closed: bool = False) -> list[float]:
    """Edges of bins: two at least, rising, whole, from ``least`` up; closed ones end in infinity."""
    out = [float(e) for e in edges]
    if len(out) < (3 if closed else 2) or any(not a < b for a, b in zip(out, out[1:])) or out[0] < least:
        raise ValueError("edges must rise and there must be enough of them")
    if closed and (out[0] != 0 or not math.isinf(out[-1])):
        raise ValueError("edges must begin at 0 and end in infinity")
    if any(not x.is_integer() for x in out if not math.isinf(x)):
        raise ValueError("edges must be whole numbers")
    return out


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Half-open bins [edge, next edge), counted from 0; null below the first edge and from the last one on."""
    n = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))
    return F.when((n > 0) & (n < len(edges)), n - 1)


def bin_label(lower: float, upper: float) -> str:
    """How a bin of counts is printed."""
    if math.isinf(upper):
        return f"\u2265{int(lower):,}"
    return f"{max(1, int(lower)):,}\u2013{int(upper) - 1:,}"


def bin_summary(rows: DataFrame, value: str, ratio: str, edges: Sequence[float]) -> DataFrame:
    """bin, label, n, median_ratio, min_ratio, max_ratio; bins without rows stay, with nulls.

    Edges begin at 0 and end in infinity; a value below 0 or without a bin fails the job.
    """
    spark, edges = rows.sparkSession, check_edges(edges, closed=True)
    names = [(k, bin_label(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    at = bin_index(F.col(value), edges)
    at = F.when(at.isNull(), F.raise_error(F.concat(F.lit("outside of all bins: "), F.coalesce(F.col(value).cast("string"), F.lit("null")))).cast("int")).otherwise(at)
    facts = rows.withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.median(ratio).alias("median_ratio"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"))
    return spark.createDataFrame(names, "bin int, label string").join(facts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "median_ratio", "min_ratio", "max_ratio")


def heat_cells(pairs: DataFrame, by: list[str], ratio: str = "ratio") -> DataFrame:
    return pairs.groupBy(*by).agg(F.median(F.log2(ratio)).alias("median_log2_ratio"))


def missing_cells(observed: DataFrame, design: DataFrame) -> DataFrame:
    """Cells of the declared design that were not observed."""
    return design.join(observed.select(*design.columns).distinct(), design.columns, "left_anti")


def unsupported_limits(limits: DataFrame, successes: DataFrame, key: list[str], batch: str, limit: str) -> DataFrame:
    """Limits without a success of the same key at a smaller batch."""
    a, b = limits.alias("a"), successes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col(f"b.{batch}") < F.col(f"a.{limit}")]
    return a.join(b, on, "left_anti")


def reached(candidates: DataFrame, limits: DataFrame, key: list[str], batch: str, limit: str) -> DataFrame:
    """Candidates at or above a known limit of their key."""
    a, b = candidates.alias("a"), limits.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col(f"b.{limit}") <= F.col(f"a.{batch}")]
    return a.join(b, on, "left_semi")


def to_resume(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return planned.join(done.select(*key).distinct(), key, "left_anti")


def schedule_faults(records: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Records (record, case_no, order_no, method) that break the cyclic schedule."""
    m = len(methods)
    want = F.get(F.array(*[F.lit(x) for x in methods]), F.pmod(F.expr(f"record div {m}") + F.pmod("record", F.lit(m)), F.lit(m)).cast("int"))
    return records.where((F.col("case_no") != F.expr(f"record div {m}")) | (F.col("order_no") != F.pmod("record", F.lit(m))) | (F.col("method") != want))


def error_metrics(actual: DataFrame, reference: DataFrame, key: list[str], value: str) -> DataFrame:
    """n, max_abs, max_rel (by the larger of 1 and the reference), mismatches; Infinity where either is not finite."""
    a = actual.select(*key, F.col(value).cast("double").alias("x"))
    b = reference.select(*key, F.col(value).cast("double").alias("y"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    gap = F.when(finite(F.col("x")) & finite(F.col("y")), F.abs(F.col("x") - F.col("y"))).otherwise(F.lit(float("inf")))
    both = a.join(b, key).withColumn("gap", gap)
    return both.agg(F.count("*").alias("n"), F.max("gap").alias("max_abs"), F.max(F.col("gap") / F.greatest(F.lit(1.0), F.abs("y"))).alias("max_rel"), F.count_if(F.col("gap") > 0).alias("mismatches"))


# The largest normalised error of each precision.
MOST_ERROR = {"FP32": 2e-3, "FP64": 1e-10}


def gate(metrics: DataFrame, most_relative: float) -> DataFrame:
    """Fails the job when an error is above the threshold or not finite, or a state differs (n_mismatches, where it is there)."""
    fine = (F.col("max_rel") <= F.lit(most_relative)) & (F.col("max_abs") < float("inf"))
    if "state_mismatches" in metrics.columns:
        fine = fine & (F.col("state_mismatches") == 0)
    said = F.concat(F.lit("error above the threshold: "), F.coalesce(F.col("max_rel").cast("string"), F.lit("null")))
    return metrics.withColumn("checked", F.when(fine, True).otherwise(F.raise_error(said).cast("boolean")))


def expected_batches(requested: Sequence[int], patterns: Column) -> Column:
    """Requested batches in their order, up to the first that takes all patterns, which is capped at them, and the whole at the end if it is not there."""
    want = F.array(*[F.lit(x).cast("long") for x in requested]).cast("array<long>")
    whole = patterns.cast("long")
    numbered_ = F.transform(want, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    first = F.coalesce(F.array_min(F.transform(F.filter(numbered_, lambda e: e["x"] >= whole), lambda e: e["i"])), F.lit(len(requested)))
    kept = F.slice(want, 1, first)
    changed = F.filter(F.transform(kept, lambda x, i: F.when((i == 0) | (x != F.get(kept, i - 1)), x)), lambda x: x.isNotNull())
    return F.concat(changed, F.array(whole))


def timing_repeats(leaves: Column, sites: Column, budget: int, least: int, most: int) -> Column:
    """As many repeats as the work budget allows, within bounds; a budget of 0 asks for the most."""
    if budget == 0:
        return F.lit(most).cast("long")
    return F.greatest(F.lit(least).cast("long"), F.least(F.lit(most).cast("long"), F.floor(F.lit(budget) / ((2 * leaves - 1) * sites)).cast("long")))


def method_id(backend: Column, baseline: Column, resource: Column, threads: Column) -> Column:
    """backend, or baseline_cpu_<threads>t, or baseline_<resource>; a resource other than cpu and cuda fails the job."""
    known = F.when(resource == "cpu", F.concat(baseline, F.lit("_cpu_"), threads.cast("string"), F.lit("t"))).when(resource == "cuda", F.concat(baseline, F.lit("_cuda")))
    known = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown resource: "), F.coalesce(resource, F.lit("null")))).cast("string"))
    return F.when(baseline.isNull(), backend).otherwise(known)


def coarse_method(method: Column) -> Column:
    """The method without its number of threads, words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(method, "_cpu_[1-9][0-9]*t$", "_cpu"), "_", "-")


def capacity_method(name: Column, threads: Column) -> Column:
    """The exact method that a capacity marker names: coarse name and threads, which must fit each other."""
    cpu = name.endswith("-cpu") & threads.rlike("^[1-9][0-9]*$")
    cuda = name.endswith("-cuda") & (threads == "1")
    exact = F.when(cpu, F.concat(F.regexp_replace(name, "-", "_"), F.lit("_"), threads, F.lit("t"))).when(cuda, F.regexp_replace(name, "-", "_")).when(~name.contains("-") & (threads == "none"), name)
    return F.coalesce(exact, F.raise_error(F.concat(F.lit("a marker of no method: "), name, F.lit(" "), threads)).cast("string"))


def measurement_scope(mode: Column, batch: Column, patterns: Column) -> Column:
    return F.when((mode == "full-input-update") | (batch == patterns), "complete-alignment-wall-time").otherwise("sum-of-per-chunk-resident-calls")


def samples(cell: Column) -> Column:
    """``v1|v2|...`` as an array."""
    return F.transform(F.split(cell, r"\|"), lambda x: x.cast("double"))


# Names that records of tasks may have.
TASKS = ("likelihood", "joint-map", "posterior-sample", "all-marginals")
UPDATES = ("full-input-update", "factor-update", "fixed-model")


def task_faults(records: DataFrame) -> DataFrame:
    """file, line_no, fault: the first rule that a record of a task (a map ``fields``) breaks."""
    f = F.col("fields")
    x = {c: number(f, c) for c in ("repeats", "cpu_ms", "accelerator_ms", "cpu_over_accelerator", "max_abs_error", "max_relative_error", "state_mismatches")}
    ratio = x["cpu_ms"] / x["accelerator_ms"]
    gap = F.abs(x["cpu_over_accelerator"] - ratio)
    near = gap <= F.greatest(F.lit(2e-8) * F.greatest(F.abs(ratio), F.abs(x["cpu_over_accelerator"])), F.lit(1e-10))
    taken = [samples(f[c]) for c in ("cpu_samples_ms", "accelerator_samples_ms")]
    odd = [F.exists(t, lambda v: v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))) for t in taken]
    reason = (
        F.when(~f["benchmark_mode"].isin(*UPDATES), "invalid mode")
        .when(~f["task"].isin(*TASKS), "invalid task")
        .when(F.coalesce(*[F.when(v.isNull(), True) for v in x.values()], F.lit(False)), "invalid numeric field")
        .when((x["repeats"] <= 0) | (x["cpu_ms"] <= 0) | (x["accelerator_ms"] <= 0), "timing fields must be positive")
        .when((x["max_abs_error"] < 0) | (x["max_relative_error"] < 0) | (x["state_mismatches"] < 0), "correctness fields must not be negative")
        .when(~near, "the ratio is not that of the times")
        .when(odd[0] | odd[1], "timing samples must be finite and positive")
        .when((F.size(taken[0]) != x["repeats"]) | (F.size(taken[1]) != x["repeats"]), "as many timing samples as repeats")
    )
    return records.select("file", "line_no", reason.alias("fault")).where("fault IS NOT NULL")


def task_summary(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """by (fields of the records), problems, median, least and most ratio, greatest errors, mismatches."""
    f, ratio = F.col("fields"), number(F.col("fields"), "cpu_over_accelerator")
    return records.groupBy(*[f[c].alias(c) for c in by]).agg(
        F.count("*").alias("problems"), F.median(ratio).alias("median_speedup"), F.min(ratio).alias("minimum_speedup"), F.max(ratio).alias("maximum_speedup"),
        F.max(number(f, "max_abs_error")).alias("max_abs_error"), F.max(number(f, "max_relative_error")).alias("max_relative_error"),
        F.sum(number(f, "state_mismatches")).cast("long").alias("state_mismatches"),
    )


def select_records(rows: DataFrame, prefix: str | None = None, **wanted: Sequence[str] | str) -> DataFrame:
    """Rows whose dataset begins with ``prefix`` and whose named columns have one of the wanted values; none left is an error."""
    out = rows if prefix is None else rows.where(F.col("dataset").startswith(prefix))
    for column, values in wanted.items():
        out = out.where(F.col(column).isin(*([values] if isinstance(values, str) else values)))
    if out.isEmpty():
        raise ValueError("no record is selected")
    return out


def not_rising(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is not above that of the row before."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("before", before).where(F.col("before") >= F.col(value))


def error_faults(records: DataFrame) -> DataFrame:
    """file, line_no, fault: the first rule of correctness that a record (a map ``fields``) breaks."""
    f = F.col("fields")
    absolute, relative = number(f, "max_abs_error"), number(f, "max_relative_error")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in MOST_ERROR.items() for x in kv]), f["precision"])
    states = f["state_mismatches"]
    reason = (
        F.when(F.coalesce(limit.isNull(), F.lit(True)), "unsupported precision")
        .when(absolute.isNull() | relative.isNull(), "invalid error field")
        .when(~_finite(absolute) | (absolute < 0), "invalid absolute error")
        .when(~_finite(relative) | (relative < 0) | (relative > limit), "normalised error above the limit")
        .when(states.isNotNull() & states.try_cast("long").isNull(), "invalid state_mismatches")
        .when(states.try_cast("long") != 0, "states differ")
    )
    return records.select("file", "line_no", reason.alias("fault")).where("fault IS NOT NULL")


def section_counts(records: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """section, n: how many records each section's condition takes; sections without any stay."""
    counts = records.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(s) for s, c in sections.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("n")) for s in sections]))
    return counts.select(pairs.alias("p")).select("p.section", "p.n")


def gate_faults(records: DataFrame, limits: DataFrame, done: DataFrame, key: list[str], sections: dict[str, Column], wanted: list[tuple[str, str]]) -> DataFrame:
    """fault, what: all that speaks against a log.

    records: file, line_no, fields; limits: key columns and first_infeasible, each of which needs a record (by the
    fields of the same names) of a smaller site_batch; done: section, precision of the markers of complete sections;
    wanted: the sections and precisions that must be complete.  A section without a record is a fault.
    """
    spark = records.sparkSession
    errors = error_faults(records).select(F.col("fault"), F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("what"))
    fitted = records.select(*[F.col("fields")[k].alias(k) for k in key], F.col("fields")["site_batch"].try_cast("long").alias("batch")).where("batch > 0")
    alone = unsupported_limits(limits, fitted, key, "batch", "first_infeasible").select(F.lit("a limit without a smaller success").alias("fault"), F.concat_ws(" ", *key).alias("what"))
    empty = section_counts(records, sections).where("n = 0").select(F.lit("a section without records").alias("fault"), F.col("section").alias("what"))
    want = spark.createDataFrame(wanted, "section string, precision string")
    open_ = want.join(done, ["section", "precision"], "left_anti").select(F.lit("a section is not complete").alias("fault"), F.concat_ws(" ", "section", "precision").alias("what"))
    return errors.unionByName(alone).unionByName(empty).unionByName(open_)


def batch_timings(batches: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the parts of each batch's time, and how many batches there were."""
    parts = [F.sum(c).alias(c) for c in ("upload_ms", "kernel_ms", "download_ms", "wall_ms")]
    return batches.groupBy(*by).agg(*parts, F.count("*").alias("batches"))


def printed(rows: DataFrame, columns: Sequence[str], order: Sequence[str], metadata: dict[str, str] | None = None) -> DataFrame:
    """line_no, line: metadata as comments, a header, and the rows as CSV in the order of the given columns; a cell with a comma or a quote is quoted."""
    spark = rows.sparkSession
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    cells = [quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    body = rows.select(*dict.fromkeys(order), F.concat_ws(",", *cells).alias("line"))
    head = [f"# {k}={' '.join(str(v).splitlines())}" for k, v in (metadata or {}).items()] + [",".join(columns)]
    first = spark.createDataFrame(list(enumerate(head, 1)), "line_no long, line string")
    places = ranked(body, [*dict.fromkeys(order), "line"], "place")
    return first.unionByName(places.select((F.col("place") + len(head) + 1).alias("line_no"), "line"))
