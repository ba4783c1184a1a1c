"""Report gates: each accepts what is right and names what is not."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cladeline.functions import generate, randomness
from cladeline.operators import corpus, encode, report, runs

LOG = """# study=one
# profile=fixture
# selected_family name=PF1 leaves=4
backend,elapsed,batch
cuda,1.5,64
metal,2.5,64,extra
# study=two
# profile=other
baseline,threads,beagle_ms
beagle,4,9
backend,something_else
cuda,7
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "a.log"
    path.write_text(LOG)
    return report.numbered_lines(spark, str(path))


def test_log_records(lines):
    good, bad = report.log_records(lines, ["cuda", "metal", "beagle"], ["backend", "baseline"], ["elapsed", "beagle_ms"], {"study": "standard"})
    rows = sorted((r.line_no, dict(r.fields)) for r in good.collect())
    assert rows == [(5, {"backend": "cuda", "elapsed": "1.5", "batch": "64", "study": "standard"}), (10, {"baseline": "beagle", "threads": "4", "beagle_ms": "9", "study": "standard"})]
    assert [(r.line_no, r.reason) for r in bad.collect()] == [(6, "wrong number of fields")]


def test_declarations_and_markers(lines):
    declared = report.declarations(lines)
    assert sorted((r.study, r.key, r.value) for r in declared.collect()) == [("one", "profile", "fixture"), ("two", "profile", "other")]
    assert report.conflicts(declared, ["study", "key"], "value").count() == 0
    assert report.conflicts(declared, ["key"], "value").count() == 1
    assert report.markers(lines, "selected_family").first().pairs == {"name": "PF1", "leaves": "4"}


def test_gate(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 100.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 100.0)], "k int, v double")
    assert report.gate(report.error_metrics(a, b, ["k"], "v"), 1e-10).first().checked
    worse = spark.createDataFrame([(1, float("nan")), (2, 100.0)], "k int, v double")
    with pytest.raises(PySparkException):
        report.gate(report.error_metrics(a, worse, ["k"], "v"), 1e-10).collect()


def test_schedule(spark):
    good = generate.cyclic_schedule(spark, 5, ["a", "b", "c"])
    assert report.schedule_faults(good, ["a", "b", "c"]).count() == 0
    assert report.schedule_faults(good.where("record <> 4").withColumn("record", F.when(F.col("record") > 4, F.col("record") - 1).otherwise(F.col("record"))), ["a", "b", "c"]).count() > 0


def test_best_batch_prefers_the_larger_of_equals(spark):
    rows = spark.createDataFrame([("p", 64, 2.0), ("p", 128, 2.0), ("p", 32, 3.0)], "problem string, batch int, ms double")
    assert report.best_batch(rows, ["problem"], "ms", "batch").first().batch == 128


def test_bins_stay_when_empty(spark):
    rows = spark.createDataFrame([(5, 1.0), (7, 3.0), (500, 2.0)], "taxa int, ratio double")
    got = report.bin_summary(rows, "taxa", "ratio", [0, 100, 2000, float("inf")]).orderBy("bin").collect()
    assert [(r.label, r.n, r.median_ratio) for r in got] == [("1–99", 2, 2.0), ("100–1,999", 1, 2.0), ("≥2,000", 0, None)]
    for edges in ([0, float("inf")], [1, 2, float("inf")], [0, 5, 5, float("inf")], [0, 1.5, float("inf")], [0, 1, 2]):
        with pytest.raises(ValueError):
            report.bin_summary(rows, "taxa", "ratio", edges)
    with pytest.raises(PySparkException):
        report.bin_summary(rows.withColumn("taxa", F.lit(-1)), "taxa", "ratio", [0, 1, float("inf")]).collect()


def test_methods_and_scopes(spark):
    rows = spark.createDataFrame([("cuda", None, None, None, "m", 1, 2), (None, "beagle", "cpu", 4, "full-input-update", 1, 2), (None, "beagle", "cuda", 1, "m", 2, 2)], "backend string, baseline string, resource string, threads int, mode string, batch int, patterns int")
    c = F.col
    got = rows.select(report.method_id(c("backend"), c("baseline"), c("resource"), c("threads")).alias("m"), report.measurement_scope(c("mode"), c("batch"), c("patterns")).alias("s"), report.expected_batches([1, 4], c("patterns")).alias("b")).collect()
    assert [r.m for r in got] == ["cuda", "beagle_cpu_4t", "beagle_cuda"] and [r.s[:3] for r in got] == ["sum", "com", "com"] and got[0].b == [1, 2]
    assert rows.select(report.samples(F.lit("1.5|2|3")).alias("x")).first().x == [1.5, 2.0, 3.0]
    with pytest.raises(PySparkException):
        rows.where("baseline IS NOT NULL").select(report.method_id(c("backend"), c("baseline"), F.lit("tpu"), c("threads"))).collect()
    for name, threads in (("beagle-cpu", "0"), ("beagle-cuda", "2"), ("cuda", "1")):
        with pytest.raises(PySparkException):
            rows.limit(1).select(report.capacity_method(F.lit(name), F.lit(threads))).collect()
    batches = lambda want, n: rows.limit(1).select(report.expected_batches(want, F.lit(n)).alias("b")).first().b
    assert [batches([512, 256], 300), batches([256, 512], 300), batches([], 7), batches([4, 4, 2], 9)] == [[300], [256, 300], [7], [4, 2, 9]]


def test_strict_scans_and_pairs(spark):
    lines = spark.createDataFrame([("a", k, x) for k, x in enumerate(["backend,ms,err", 'cuda,"1,5",2', "cuda,1,nan", "cuda,0,1", "cuda,1", "cuda,2,1"])], "file string, line_no int, line string")
    records, rejects = report.log_records(lines, ["cuda"], ["backend"], ["ms"], {}, ["err", "study"], ["err"])
    assert records.count() == 0 and {r.reason for r in rejects.collect()} == {"lacks study", "wrong number of fields"}
    records, rejects = report.log_records(lines, ["cuda"], ["backend"], ["ms"], {}, [], ["err"])
    assert [(r.line_no, r.reason) for r in rejects.orderBy("line_no").collect()] == [(1, "elapsed time not positive"), (2, "not finite: err"), (3, "elapsed time not positive"), (4, "wrong number of fields")]
    with pytest.raises(ValueError, match="a:1"):
        report.strict(records, rejects)
    assert report.strict(records, rejects.limit(0)).count() == 1
    with pytest.raises(ValueError, match="no records"):
        report.strict(records.limit(0), rejects.limit(0))
    rows = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 4.0), ("x", 2, 1.0)], "m string, k int, v double")
    assert [r.ratio for r in report.paired(rows, ["k"], "m", "x", "y", "v").collect()] == [2.0]
    for broken in (rows, rows.unionByName(rows.where("m = 'y'")).where("k = 1")):
        with pytest.raises(PySparkException):
            report.paired(broken, ["k"], "m", "x", "y", "v", strict=True).collect()
    with pytest.raises(PySparkException):
        report.paired(rows.unionByName(rows.where("k = 1")), ["k"], "m", "x", "y", "v").collect()
    with pytest.raises(ValueError):
        report.select_records(rows.withColumn("dataset", F.lit("a")), "b")


def test_encoding_is_one_to_one(spark):
    leaves = spark.createDataFrame([(1, "a"), (2, "b")], "node_id long, label string")
    fine = [("a", "AC"), ("b", "GT")]
    assert encode.encode(leaves, spark.createDataFrame(fine, "name string, sequence string")).count() == 4
    for broken in (fine[:1], [*fine, ("c", "AA")], [*fine, fine[0]]):
        with pytest.raises(PySparkException):
            encode.encode(leaves, spark.createDataFrame(broken, "name string, sequence string")).collect()
    for first, count in ((0, 0), (-1, 2), (3, 2)):
        with pytest.raises(ValueError):
            encode.select_sites(leaves, first, count, 4)


def test_bounded_runs():
    import sys

    from cladeline.operators import runs

    assert runs.bounded([sys.executable, "-c", "print(7)"]).strip() == "7"
    with pytest.raises(runs.CapacityError):
        runs.bounded([sys.executable, "-c", "x = bytearray(4 << 30)"], limit=1 << 30)
    with pytest.raises(runs.CapacityError):
        runs.bounded([sys.executable, "-c", "import sys; sys.exit(137)"])
    with pytest.raises(RuntimeError) as e:
        runs.bounded([sys.executable, "-c", "import sys; sys.exit(3)"])
    assert not isinstance(e.value, runs.CapacityError)


def test_manifest(spark):
    good = ("a", "4", "10", "5", "a/x.fa", "a/w.txt", "a/t.nwk", *["0" * 64] * 3)
    bad = [good, ("b", "0", *good[2:]), ("c", *good[1:4], "../x", *good[5:]), ("d", *good[1:7], "xyz", *good[8:]), ("e", *good[1:]), ("e", *good[1:])]
    frame = spark.createDataFrame(bad, ", ".join(f"{c} string" for c in corpus.MANIFEST))
    faults = sorted((r.dataset, r.fault) for r in corpus.manifest_faults(frame).collect())
    assert faults == [("b", "taxa is not a count"), ("c", "alignment leaves the folder"), ("d", "normalized_alignment_sha256 is not a digest"), ("e", "dataset occurs twice"), ("e", "dataset occurs twice")]
    with pytest.raises(ValueError):
        corpus.manifest_faults(frame.drop("taxa"))
    files = spark.createDataFrame([("x", randomness.sha256_file(b"1")), ("y", "no"), ("z", "no")], "path string, sha256 string")
    contents = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"2"))], "path string, content binary")
    assert sorted((r.path, r.fault) for r in corpus.digest_faults(files, contents).collect()) == [("y", "digest differs"), ("z", "missing")]


def test_logs_of_tree_programs(spark):
    rows = spark.createDataFrame([("DataType: DNA\nModel: LG",), ("Model: GTR+G\nModel: HKY",), ("Model: LG",), ("Alignment sites / patterns: 120 / 7",)], "text string")
    got = rows.select(corpus.is_nucleotide_log(F.col("text")).alias("n"), corpus.alignment_sites(F.col("text")).alias("s")).collect()
    assert [r.n for r in got] == [True, True, False, False] and [r.s for r in got] == [None, None, None, 120]


def test_select_tree(spark):
    rows = spark.createDataFrame([("b", -1.0), ("a", -1.0), ("c", float("nan")), ("d", float("inf")), ("e", -2.0)], "newick string, log_likelihood double")
    assert corpus.select_tree(rows).first().newick == "a"


def test_metadata():
    assert corpus.write_metadata({"a": "1\n2"}) == "a=1 2\n"
    with pytest.raises(ValueError):
        corpus.write_metadata({"a b": "1"})


def test_decoding_fails_on_other_letters(spark):
    codes = spark.createDataFrame([(c,) for c in "acgtuRYSWKMBDHVNX?-."], "c string")
    assert [r.m for r in codes.select(encode.decoded(F.col("c")).alias("m")).collect()] == [1, 2, 4, 8, 8, 5, 10, 6, 9, 12, 3, 14, 13, 11, 7, 15, 15, 15, 15, 15]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("Z",)], "c string").select(encode.decoded(F.col("c"))).collect()


def test_compression(spark):
    sites = spark.createDataFrame([(0, 1, 2), (1, 4, 8), (2, 1, 2), (3, 4, 8)], "site long, m1 int, m2 int")
    got = encode.numbered(encode.compress(sites, ["m1", "m2"])).orderBy("pattern").collect()
    assert [(r.pattern, r.m1, r.weight, r.first_site) for r in got] == [(0, 1, 2, 0), (1, 4, 2, 1)]


def test_pairs_and_coverage(spark):
    rows = spark.createDataFrame([("x", "p", 1.0), ("y", "p", 3.0), ("x", "q", 1.0)], "method string, problem string, ms double")
    assert report.paired(rows, ["problem"], "method", "x", "y", "ms").first().ratio == 3.0
    assert [(r.problem, r.missing) for r in report.unpaired(rows, ["problem"], "method", "x", "y").collect()] == [("q", "y")]


def test_logs_of_many_splits_are_numbered_and_carried_as_wholes(spark, tmp_path, monkeypatch):
    """Lines of one log come from many splits and files, and a header far above still counts."""
    rng, text = np.random.default_rng(2), []
    for k in range(3_000):
        text.append(["cuda,%d" % k, "", "# note %d" % k, "x" * int(rng.integers(0, 90)), "backend,ms%d" % k if rng.random() < 0.02 else "cuda,1"][int(rng.integers(0, 5))] + ("\r" if rng.random() < 0.1 else ""))
    (tmp_path / "log=a").mkdir()
    (tmp_path / "log=b").mkdir()
    (tmp_path / "log=a" / "part-0").write_text("\n".join(text[:1_700]) + "\n", newline="")
    (tmp_path / "log=a" / "part-1").write_text("\n".join(text[1_700:]) + "\n", newline="")
    (tmp_path / "log=b" / "part-0").write_text("backend,only\ncuda,5", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = report.numbered_lines(spark, str(tmp_path), F.regexp_extract("file", "log=([a-z])", 1))
        assert lines.rdd.getNumPartitions() > 3
        got = {(r.file, r.line_no): r.line for r in lines.collect()}
        want = {("a", k + 1): x.strip(" ").rstrip("\r").strip(" ") for k, x in enumerate(text)} | {("b", 1): "backend,only", ("b", 2): "cuda,5"}
        assert got == want
        for width in (7, 1_000, 65_536):
            carried = report.carry_forward(lines, ["file"], "line_no", F.when(F.col("line").startswith("backend"), F.col("line")), "header", width)
            held, last = {}, {}
            for (f, k), x in sorted(want.items()):
                last[f] = x if x.startswith("backend") else last.get(f)
                held[f, k] = last[f]
            assert {(r.file, r.line_no): r.header for r in carried.collect()} == held
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _shown(lines, level):
    """The view's rules one line at a time: (number, kind) of what is shown."""
    import re

    out, tenth = [], {}
    for k, x in lines:
        kind = "milestone" if x.startswith(runs.MILESTONES) else "error" if re.search(runs.ERRORS, x) or "ERROR SUMMARY:" in x else None
        if kind is None and level != "quiet":
            m = re.search(r"(?:case|cases_through)=([0-9]+)/([0-9]+)", x)
            if x.startswith(("===", "# task_progress ")):
                kind = "heading"
            elif x.startswith("# progress ") and m and 0 < int(m[2]) >= int(m[1]):
                now, total, said = int(m[1]), int(m[2]), dict(re.findall(r"([A-Za-z_][A-Za-z0-9_-]*)=([^ ]+)", x))
                run = (*(said.get(i, "") for i in runs.IDENTITY), total)
                if now in (1, total) or now * 10 // total > tenth.get(run, -1):
                    tenth[run], kind = now * 10 // total, "progress"
        if kind is None and level == "full":
            kind = "line" if not (x.startswith("# progress ") and m and 0 < int(m[2]) >= int(m[1])) else "progress"
        if kind:
            out.append((k, kind))
    return sorted(out)


def _a_log():
    rng = np.random.default_rng(3)
    lines = ["# progress method=a case=%d/40 precision=FP32" % k for k in range(0, 42)] + ["# progress method=a cases_through=%d/7" % (k % 8) for k in range(30)] + ["# progress case=3/0", "# progress", "fatal", "no fatality", "x Error: y", "== ERROR SUMMARY: 0", "=== head", "# task_progress x", "# capacity_limit a=b", "# other", "plain,row", "# progress method=b method=a case=39/40 precision=FP32"]
    at = rng.permutation(len(lines) * 2) % len(lines)
    return [(k, lines[i]) for k, i in enumerate(at)]


@pytest.mark.parametrize("level", runs.LEVELS)
def test_a_view_shows_what_the_rules_say(spark, level):
    lines = _a_log()
    frame = spark.createDataFrame([("f", k, x) for k, x in lines], "file string, line_no long, line string")
    assert sorted((r.line_no, r.kind) for r in runs.rendered(frame, level).collect()) == _shown(lines, level)


def test_a_live_view_goes_on_after_a_restart(spark, tmp_path):
    from cladeline.streaming.streams import render_available

    lines = _a_log()
    arriving, shown, state = (f"file://{tmp_path}/{x}" for x in ("lines", "shown", "state"))
    for k in range(0, len(lines), 40):
        spark.createDataFrame([("f", n, x) for n, x in lines[k : k + 40]], "file string, line_no long, line string").coalesce(1).write.mode("append").parquet(arriving)
        if k % 80:
            render_available(spark, arriving, shown, state)
    render_available(spark, arriving, shown, state)
    assert sorted((r.line_no, r.kind) for r in spark.read.parquet(shown).collect()) == _shown(lines, "compact")


def test_a_report_rests_on_one_protocol(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None)], "n long, mode string, batch long")
    assert runs.one_protocol(rows, ["mode", "batch"]).count() == 2
    assert runs.one_protocol(rows.limit(0), ["mode"]).count() == 0
    with pytest.raises(PySparkException, match="different protocols"):
        runs.one_protocol(rows.withColumn("batch", F.col("n")), ["mode", "batch"]).collect()
