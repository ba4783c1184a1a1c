import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cladeline.sources.store import Store
from cladeline.operators import encode, prepare, report, runs
from cladeline.sources.text import parse_newick


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def _tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


@pytest.mark.parametrize("pack", [_zip, _tar])
def test_archives(spark, tmp_path, pack):
    read = lambda: prepare.archived_sequences(spark, f"file://{tmp_path}/{name}", store).orderBy("offset").collect()
    name = "a.tar.gz" if pack is _tar else "a.bin"
    with Store(spark, "t") as store:
        (tmp_path / name).write_bytes(pack([("x/readme.txt", "no"), ("x/a.fasta", ">A\nACGT\n>B\nAC-T\n")]))
        assert [(r.name, r.sequence) for r in read()] == [("A", "ACGT"), ("B", "AC-T")]
        for k, broken in enumerate(("AC\n>A\nAC\n", ">A\nAC\n>B\nA\n", ">\nAC\n", ">A\nA!\n", ">A\n", "")):
            name = f"{k}.tar.gz" if pack is _tar else f"{k}.bin"
            (tmp_path / name).write_bytes(pack([("a.fa", broken)]))
            with pytest.raises(PySparkException):
                read()


def test_weights(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" 1 22\n3\t4\n")
    assert [r.weight for r in prepare.pattern_weights(spark, str(tmp_path / "w.txt"), 4).orderBy("pattern").collect()] == [1, 22, 3, 4]
    with pytest.raises(ValueError):
        prepare.pattern_weights(spark, str(tmp_path / "w.txt"), 3)
    (tmp_path / "v.txt").write_text("1 0")
    with pytest.raises(PySparkException):
        prepare.pattern_weights(spark, str(tmp_path / "v.txt"), 2).collect()


def test_labels():
    tree = prepare.cut_labels(b"[a (comment] ('X1, Somewhat \xa0odd':0.1,'X2,b':0.2)r;")
    assert [label for _, _, label, _ in parse_newick(tree)] == ["r", "X1", "X2"]


def test_canonical_names(spark):
    rows = spark.createDataFrame([("synthetic-jc69-yule-0032-8-0.0010",), ("other-1-2-3",), ("synthetic-jc69-yule-x",)], "n string")
    assert [r.c for r in rows.select(prepare.canonical_dataset(F.col("n")).alias("c")).collect()] == ["synthetic-jc69-yule-32-8-0.001", "other-1-2-3", "synthetic-jc69-yule-x"]


def test_two_passes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ACG-AA"), ("b", "AC-TAC"), ("c", "AUNTAG")], "name string, sequence string")
    kept, cut = prepare.two_pass(rows, 0.6, f"file://{tmp_path}/stats")
    assert [(r.site, r.covered, r.variable) for r in kept.collect()] == [(0, 3, False), (1, 3, True), (3, 2, False), (4, 3, False), (5, 3, True)]
    assert {r.name: r.sequence for r in cut.collect()} == {"a": "AC-AA", "b": "ACTAC", "c": "AUTAG"}
    assert prepare.two_pass(rows, 0.6, f"file://{tmp_path}/stats")[0].count() == 5
    # other sequences, or another member, are not served from what is kept for these
    changed = rows.replace({"ACG-AA": "A-G-AA"}, subset=["sequence"])
    kept, _ = prepare.two_pass(changed, 0.6, f"file://{tmp_path}/stats")
    assert [(r.site, r.covered) for r in kept.collect()] == [(0, 3), (1, 2), (3, 2), (4, 3), (5, 3)]
    assert len(list((tmp_path / "stats").iterdir())) == 2
    assert prepare.two_pass(rows, 0.6, f"file://{tmp_path}/stats", member="x.fa")[0].count() == 5 and len(list((tmp_path / "stats").iterdir())) == 3


def test_column_statistics_by_blocks_and_their_faults(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"s{k}", "".join(rng.choice(list("ACGTUNR-acx"), int(rng.integers(0, 60))))) for k in range(40)] + [("none", None), ("empty", "")]
    frame = spark.createDataFrame(rows, "name string, sequence string").repartition(3)
    cells = frame.select("name", F.posexplode(F.split("sequence", "")).alias("site", "code")).where("code <> ''")
    want = sorted(tuple(r) for r in encode.column_coverage(cells.select("site", encode.decode(F.col("code")).alias("mask"))).collect())
    monkeypatch.setattr(prepare, "BLOCK", 16)
    assert sorted(tuple(r) for r in prepare.column_statistics(frame).collect()) == want
    kept, cut = prepare.two_pass(frame, 0.2, f"file://{tmp_path}/stats")
    places = [r.site for r in kept.collect()]
    assert 0 < len(places) < 60 and {r.name: r.sequence for r in cut.collect()} == {n: None if s is None else "".join(s[k] for k in places if k < len(s)) for n, s in rows}
    with pytest.raises(Exception, match="no code"):
        prepare.column_statistics(spark.createDataFrame([("a", "AC!")], "name string, sequence string")).collect()
    assert prepare.column_statistics(frame.limit(0)).count() == 0


def test_simulation_by_depth():
    nodes = parse_newick("((A:0.0,B:0.1):0.2,C:5);")
    a = prepare.simulate_by_depth(nodes, 200, 5)
    assert a == prepare.simulate_by_depth(nodes, 200, 5) and set(a) == {"A", "B", "C"} and a != prepare.simulate_by_depth(nodes, 200, 6)
    same = lambda x, y: sum(p == q for p, q in zip(a[x], a[y])) / 200
    assert same("A", "B") > 0.8 > 0.45 > same("A", "C")


@pytest.mark.parametrize("wrong", [{"leaves": 1}, {"mode": "x"}, {"model": "x"}, {"categories": 4}, {"gamma_shape": 1.0}, {"tree": "t"}, {"weights": "w"}, {"height": -1.0}, {"mode": "fixed-model", "site_batch": 8}, {"repeats": 0}])
def test_options_are_checked(wrong):
    with pytest.raises(ValueError):
        runs.Options(**wrong)


def test_options():
    a, b = runs.Options(model="gtr", categories=4, gamma_shape=0.7), runs.Options()
    assert a.identity() != b.identity() == runs.Options().identity()
    assert a.evolution()[1].count == 4 and b.evolution()[0].exch == (1.0,) * 6


def test_capacity_search():
    def run(batch):
        if batch > 100:
            raise runs.CapacityError
        return -batch

    assert runs.descending(run, 512) == (64, -64, [512, 256, 128])
    assert runs.ascending(run, [32, 64, 128, 256]) == ([(32, -32), (64, -64)], 128)
    with pytest.raises(runs.CapacityError):
        runs.descending(run, 512, 200)
    with pytest.raises(ZeroDivisionError):
        runs.descending(lambda b: 1 / 0, 4)


def test_interleaving():
    seen = []
    got = runs.interleaved({"a": lambda: seen.append("a"), "b": lambda: seen.append("b")}, 3)
    assert "".join(seen) == "abababab" and [len(v) for v in got.values()] == [3, 3]
    assert runs.summary([1.0, 2.0, 3.0])["median"] == 2.0


def test_protocols_and_identity(spark, tmp_path):
    (tmp_path / "a.log").write_text("# study=s\n# run_identity=abc\n# manifest=m1\n# method=cuda\n# progress method=x cases=4\n# manifest=m2\n# method=cpu\n")
    lines = report.numbered_lines(spark, str(tmp_path / "a.log"))
    blocks, faults = runs.protocol_blocks(lines, "manifest")
    row = blocks.first()
    assert blocks.count() == 1 and row.opened == "m1" and row.pairs["method"] == "cuda" and row.pairs["cases"] == "4"
    assert [r.session for r in faults.collect()] == [2]
    assert runs.run_identity(lines) == "abc"
    with pytest.raises(ValueError):
        runs.run_identity(lines, "abc")


def test_completeness(spark):
    rows = spark.createDataFrame([("g", 0), ("g", 1), ("h", 0), ("h", 0), ("i", 0), ("i", 1), ("i", 7)], "g string, r int")
    got = {r.g: (r.missing, r.unknown, r.twice) for r in runs.completeness(rows, ["g"], "r", [0, 1]).collect()}
    assert got == {"h": ([1], [], True), "i": ([], [7], False)}
