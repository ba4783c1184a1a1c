"""Running studies: options, capacity search, resumption, protocols and timing."""

from __future__ import annotations

import hashlib
import re
import subprocess
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, fields
from statistics import median

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.generate import default_lengths, simulate_jukes_cantor, topology, unique_patterns
from ..functions.models import NucleotideModel, RateMixture, discrete_gamma, gtr, hky, jukes_cantor
from ..functions.randomness import sequence_seed, topology_seed
from ..functions.trees import Tree, floor_lengths
from .report import declarations, marker_pairs, markers, sessions, to_resume

# The frequencies and exchangeabilities of the presets.
PRESET_PI = (0.3, 0.2, 0.2, 0.3)
PRESET_EXCH = (1.2, 3.1, 0.7, 1.8, 4.6, 0.9)

# What is worked out anew before each run.
MODES = ("full-input-update", "factor-update", "fixed-model")


class CapacityError(RuntimeError):
    """A run that did not fit; anything else that goes wrong is an error and is not retried."""


@dataclass(frozen=True)
class Options:
    """What a run measures; contradictions are refused when it is made."""

    leaves: int = 64
    sites: int = 256
    topology: str = "balanced"
    replicate: int = 0
    seed: int = 20260813
    site_batch: int = 0
    mode: str = "full-input-update"
    model: str = "jc69"
    kappa: float = 4.0
    rate: float = 1.0
    categories: int = 1
    gamma_shape: float | None = None
    height: float | None = None
    minimum_length: float = 0.0
    repeats: int = 5
    tree: str | None = None
    alignment: str | None = None
    weights: str | None = None

    def __post_init__(self):
        problems = [
            (self.leaves < 2, "two leaves at least"),
            (self.sites < 1 or self.repeats < 1 or self.site_batch < 0, "counts must be positive"),
            (self.mode not in MODES, f"the mode is one of {', '.join(MODES)}"),
            (self.model not in ("jc69", "hky", "gtr"), "the model is jc69, hky or gtr"),
            ((self.categories > 1) != (self.gamma_shape is not None), "several categories need a gamma shape, and the other way round"),
            ((self.tree is None) != (self.alignment is None), "a tree needs an alignment, and the other way round"),
            (self.weights is not None and self.alignment is None, "weights need an alignment"),
            (self.height is not None and (self.tree is not None or self.height <= 0), "a height is positive and of synthetic trees"),
            (self.mode != "full-input-update" and 0 < self.site_batch < self.sites, "resident modes take all sites in one batch"),
            (self.minimum_length < 0, "the least length must not be negative"),
        ]
        for broken, text in problems:
            if broken:
                raise ValueError(text)

    def evolution(self) -> tuple[NucleotideModel, RateMixture]:
        made = {"jc69": lambda: jukes_cantor(self.rate), "hky": lambda: hky(PRESET_PI, self.kappa, self.rate), "gtr": lambda: gtr(PRESET_PI, PRESET_EXCH, self.rate)}
        return made[self.model](), RateMixture() if self.categories == 1 else discrete_gamma(self.gamma_shape, self.categories)

    def identity(self) -> str:
        """The same for the same settings only; names a run's records."""
        return hashlib.sha256("\n".join(f"{k}={v}" for k, v in sorted(asdict(self).items())).encode()).hexdigest()


# The options' names on a command line, and what each is called here.
FLAGS = {
    "leaves": "leaves", "sites": "sites", "topology": "topology", "replicate": "replicate", "seed": "seed", "site-batch": "site_batch",
    "benchmark-mode": "mode", "substitution-model": "model", "hky-kappa": "kappa", "substitution-rate": "rate", "rate-categories": "categories",
    "gamma-shape": "gamma_shape", "root-to-tip-distance": "height", "minimum-branch-length": "minimum_length", "repeats": "repeats",
    "newick": "tree", "alignment": "alignment", "pattern-weights": "weights",
}


def parse_options(words: Sequence[str]) -> Options:
    """Options of ``--name value`` or ``--name=value`` words; an unknown name, one given twice, a value that is missing or no number is refused."""
    kinds, given, at = {f.name: f.type for f in fields(Options)}, {}, 0
    while at < len(words):
        name, eq, value = words[at].removeprefix("--").partition("=")
        at += 1
        if not words[at - 1].startswith("--") or name not in FLAGS:
            raise ValueError(f"unknown option: {words[at - 1]}")
        if not eq:
            if at == len(words):
                raise ValueError(f"no value: --{name}")
            value, at = words[at], at + 1
        if FLAGS[name] in given:
            raise ValueError(f"given twice: --{name}")
        kind = kinds[FLAGS[name]]
        try:
            given[FLAGS[name]] = int(value) if kind == "int" else float(value) if kind.startswith("float") else value
        except ValueError:
            raise ValueError(f"no number: --{name} {value}") from None
    return Options(**given)


@dataclass
class Study:
    """A problem to be run: a tree with lengths, its distinct columns, and what was done to it."""

    tree: Tree
    sites: DataFrame  # site, nodes, masks, weight
    floored: int
    shape: dict


def make_problem(spark: SparkSession, options: Options) -> Study:
    """The synthetic problem of some options: with a height, a clock-like tree with simulated sites, compressed; else distinct columns."""
    seed = topology_seed(options.seed, options.leaves, options.replicate, options.topology)
    parents = topology(options.topology, options.leaves, seed)
    bare = Tree(parents, np.zeros(len(parents)))
    lengths = bare.clock_like(options.height) if options.height else np.where(parents < 0, 0.0, default_lengths(len(parents), options.seed))
    lengths, floored = floor_lengths(lengths, options.minimum_length)
    lengths = np.where(parents < 0, 0.0, lengths)
    tree = Tree(parents, lengths)
    tips = F.array(*[F.lit(int(v)).cast("long") for v in tree.leaves])
    if options.height:
        masks = simulate_jukes_cantor(tree, options.sites, sequence_seed(seed, options.sites, options.height))
        kinds, first, weight = np.unique(masks, axis=0, return_index=True, return_counts=True)
        order = np.argsort(first)
        rows = [(int(first[k]), kinds[k].tolist(), int(weight[k])) for k in order]
        sites = spark.createDataFrame(rows, "site long, masks array<int>, weight long").select("site", tips.alias("nodes"), "masks", "weight")
    else:
        made = unique_patterns(spark, options.sites, options.leaves, options.seed)
        cells = F.transform(F.sequence(F.lit(0), F.lit(options.leaves - 1)), lambda i: F.conv(F.substr(F.hex("masks"), 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
        sites = made.select("site", tips.alias("nodes"), cells.alias("masks"), F.lit(1).cast("long").alias("weight"))
    return Study(tree, sites, floored - int(options.minimum_length > 0), tree.shape())


def memory_limit(host: Column, group: Column, percent: Column) -> Column:
    """Bytes that a run may take: a share of the machine's memory or of the group's limit, if that is less; the share is from 20 to 90."""
    fine = percent.between(20, 90)
    share = F.floor(F.least(host, F.coalesce(group, host)) * percent / 100).cast("long")
    return F.when(fine, share).otherwise(F.raise_error(F.concat(F.lit("a share from 20 to 90, not "), percent.cast("string"))).cast("long"))


# How a run ends that did not fit in memory.
CAPACITY_EXIT = 137
CAPACITY_TEXT = re.compile(r"bad_alloc|out of memory|MemoryError|cannot allocate|OutOfMemoryError", re.I)


def bounded(command: Sequence[str], limit: int | None = None, timeout: float | None = None) -> str:
    """What a command prints, run with at most ``limit`` bytes of address space.

    A run that memory ended (by its exit code or by what it says) raises CapacityError; any other failure RuntimeError.
    """

    def bound():
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (limit, limit))

    done = subprocess.run(list(command), capture_output=True, text=True, timeout=timeout, preexec_fn=bound if limit else None)
    if done.returncode in (CAPACITY_EXIT, -9) or (done.returncode and CAPACITY_TEXT.search(done.stderr + done.stdout)):
        raise CapacityError(f"{command[0]} did not fit")
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-500:]}")
    return done.stdout


def resumed(planned: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, key: list[str]) -> DataFrame:
    """All records under ``path`` after what was planned and is not yet there has been run and added."""
    spark = planned.sparkSession
    try:
        done = spark.read.parquet(path)
        left = to_resume(planned, done, key)
    except AnalysisException:
        left = planned
    run(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def descending(run: Callable[[int], object], start: int, least: int = 1) -> tuple[int, object, list[int]]:
    """(batch, result, batches that did not fit): halves the batch until a run fits."""
    failed, batch = [], start
    while True:
        try:
            return batch, run(batch), failed
        except CapacityError:
            failed.append(batch)
            if batch <= least:
                raise
            batch = max(least, batch // 2)


def ascending(run: Callable[[int], object], batches: Iterable[int]) -> tuple[list[tuple[int, object]], int | None]:
    """(runs that fitted, the first batch that did not): stops at the first failure."""
    done = []
    for batch in batches:
        try:
            done.append((batch, run(batch)))
        except CapacityError:
            return done, batch
    return done, None


def interleaved(methods: dict[str, Callable[[], object]], repeats: int, conditioning: float = 0.0) -> dict[str, list[float]]:
    """Seconds of each method's runs; methods alternate, each once untimed before, for ``conditioning`` seconds at least."""
    began = time.perf_counter()
    while True:
        for run in methods.values():
            run()
        if time.perf_counter() - began >= conditioning:
            break
    out: dict[str, list[float]] = {m: [] for m in methods}
    for _ in range(repeats):
        for name, run in methods.items():
            began = time.perf_counter()
            run()
            out[name].append(time.perf_counter() - began)
    return out


def summary(samples: Sequence[float]) -> dict[str, float]:
    x = np.array(samples, float)
    return {"median": median(samples), "p25": float(np.quantile(x, 0.25)), "p75": float(np.quantile(x, 0.75))}


def protocol_blocks(lines: DataFrame, start: str, end: str = "progress") -> tuple[DataFrame, DataFrame]:
    """(blocks, faults) of a log: a block opens at a ``# start=value`` line and closes at ``# end k=v ...``.

    blocks: file, session, opened, pairs (the last declaration of a key, which wins over what the closing line repeats).  faults: blocks
    that another opens inside of, or that never close.
    """
    opened = F.regexp_extract("line", rf"^#\s*{start}=(.*)$", 1)
    rows = sessions(lines.withColumn("opened", opened), ["file"], "line_no", F.col("opened") != "").where("session > 0")
    key, value = F.regexp_extract("line", r"^#\s*(\w+)=(.*)$", 1), F.regexp_extract("line", r"^#\s*\w+=(.*)$", 1)
    last = rows.groupBy("file", "session", key.alias("key")).agg(F.max("opened").alias("opened"), F.max_by(value, "line_no").alias("value"))
    heads = last.groupBy("file", "session").agg(F.max("opened").alias("opened"), F.map_from_entries(F.collect_list(F.when(F.col("key") != "", F.struct("key", "value")))).alias("declared"))
    closing = markers(lines, end).withColumnRenamed("line_no", "closed_at")
    ends = rows.select("file", "session", F.col("line_no").alias("closed_at")).join(closing, ["file", "closed_at"])
    ends = ends.groupBy("file", "session").agg(F.min_by("pairs", "closed_at").alias("said"), F.count("*").alias("n"))
    both = heads.join(ends, ["file", "session"], "left")
    pairs = F.map_zip_with("said", "declared", lambda k, a, b: F.coalesce(b, a))
    return both.where("n >= 1").select("file", "session", "opened", pairs.alias("pairs")), both.where("n IS NULL").select("file", "session", F.lit("a block is not closed").alias("fault"))


def completeness(rows: DataFrame, by: list[str], value: str, wanted: Sequence) -> DataFrame:
    """Groups that lack a wanted value, have another, or have one twice, with what is wrong."""
    have, want = F.collect_set(value), F.array(*[F.lit(v) for v in wanted])
    got = rows.groupBy(*by).agg(have.alias("have"), F.count("*").alias("n"))
    return got.select(*by, F.array_except(want, "have").alias("missing"), F.array_except("have", want).alias("unknown"), (F.col("n") > F.size("have")).alias("twice")).where("size(missing) > 0 OR size(unknown) > 0 OR twice")


def distinct_protocols(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The protocols in use; a report may rest on one."""
    return rows.select(*columns).distinct()


def one_protocol(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, if all have one protocol; else the job fails and names two."""
    fields = F.struct(*columns)
    ends = rows.agg(F.min(fields).alias("a"), F.max(fields).alias("b"))
    wrong = F.raise_error(F.concat(F.lit("different protocols: "), F.to_json("a"), F.lit(" and "), F.to_json("b"))).cast("boolean")
    right = ends.select(F.when(F.col("a").eqNullSafe(F.col("b")), F.lit(True)).otherwise(wrong).alias("one"))
    return rows.crossJoin(F.broadcast(right)).where("one").drop("one")  # one row


def agreement(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, protocols (how many distinct ones a group has), agrees."""
    return rows.groupBy(*by).agg(F.count_distinct(F.struct(*columns)).alias("protocols")).withColumn("agrees", F.col("protocols") == 1)


# What a live view shows of a log.
MILESTONES = (
    "# benchmark_suite_", "# benchmark_precision_complete", "# benchmark_section_complete", "# portability_compile_", "# validation_complete", "# validation_incomplete",
    "# validation_sanitizer_skipped", "# correctness_gate_", "# baseline_unavailable", "# capacity_limit", "# capacity_failure",
)
ERRORS = r"(?i)(?:^|[ :])(critical error|error|failed|failure|fatal)(?:[ :=-]|$)"
IDENTITY = ("method", "precision", "study", "benchmark_mode", "threads")
LEVELS = ("quiet", "compact", "full")


def classified(lines: DataFrame, level: str = "compact") -> DataFrame:
    """file, line_no, line, kind of lines that are shown for what they say; and where progress decides, identity, bucket (tenths) and resets.

    ``quiet`` shows milestones and errors, ``compact`` also headings and progress, ``full`` all lines.  A progress line counts if it has a
    position of 0 to its total, above 0; its identity is its run's settings and total.  The first and the last position reset.
    """
    if level not in LEVELS:
        raise ValueError(f"no level {level}")
    line = F.col("line")
    starts = lambda *with_: F.exists(F.array(*map(F.lit, with_)), lambda x: F.startswith(line, x))
    kind = F.when(starts(*MILESTONES), "milestone").when(line.rlike(ERRORS) | F.contains(line, F.lit("ERROR SUMMARY:")), "error")
    if level != "quiet":
        kind = kind.when(starts("===", "# task_progress "), "heading")
    position = lambda k: F.regexp_extract("line", r"(?:case|cases_through)=([0-9]+)/([0-9]+)", k).try_cast("long")
    keys, values = (F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_-]*)=([^ ]+)"), F.lit(k)) for k in (1, 2))
    said = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = lambda name: F.coalesce(F.try_element_at(F.filter(said, lambda e: e["k"] == name), F.lit(-1))["v"], F.lit(""))
    rows = lines.withColumn("kind", kind).withColumn("now", position(1)).withColumn("total", position(2))
    moves = F.col("kind").isNull() & F.startswith(line, F.lit("# progress ")) & (F.col("total") > 0) & (F.col("now") <= F.col("total")) & F.lit(level != "quiet")
    rows = rows.withColumn("moves", F.coalesce(moves, F.lit(False)))
    when = lambda x: F.when(F.col("moves"), x)
    rows = rows.select(
        "file", "line_no", "line", F.coalesce("kind", F.when(F.lit(level == "full") & ~F.col("moves"), "line")).alias("kind"), when(F.to_json(F.array(*map(last, IDENTITY), F.col("total").cast("string")))).alias("identity"),
        when(F.least(F.lit(10), F.expr("now div total * 10 + now % total * 10 div total")).cast("int")).alias("bucket"), when(F.col("now").isin(1) | (F.col("now") == F.col("total"))).alias("resets"),
    )
    return rows.where("kind IS NOT NULL OR bucket IS NOT NULL")


def rendered(lines: DataFrame, level: str = "compact") -> DataFrame:
    """file, line_no, kind, line of what a view of a log shows: see classified().

    A progress line is shown if it resets its run, or is in a further tenth than its run's last one shown since.
    """
    rows = classified(lines, level)
    run = W.partitionBy("file", "identity").orderBy("line_no")
    moving = rows.where("bucket IS NOT NULL").withColumn("part", F.sum(F.col("resets").cast("int")).over(run))
    before = F.max("bucket").over(W.partitionBy("file", "identity", "part").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    shown = moving.withColumn("before", before).where(F.lit(level == "full") | F.col("resets") | F.col("before").isNull() | (F.col("bucket") > F.col("before")))
    return rows.where("bucket IS NULL").select("file", "line_no", "kind", "line").unionByName(shown.select("file", "line_no", F.lit("progress").alias("kind"), "line"))


def run_identity(lines: DataFrame, override: str | None = None) -> str:
    """The one identity that all logs are marked with; an override counts only if none is marked."""
    marked = declarations(lines).where("key = 'run_identity'").select("file", "value")
    files = lines.select("file").distinct()
    values = [r["value"] for r in marked.select("value").distinct().limit(2).collect()]
    if not values:
        if override is None:
            raise ValueError("no log is marked and no identity is given")
        return override
    if override is not None or len(values) > 1 or not files.join(marked, "file", "left_anti").isEmpty():
        raise ValueError("logs of different runs")
    return values[0]
