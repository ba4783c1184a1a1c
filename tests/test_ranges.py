"""Files by byte ranges and archives by members, against Python's own readers."""

import io
import tarfile
import zipfile

import numpy as np
import pytest

from cladeline.operators import prepare
from cladeline.sources import ranges
from cladeline.sources.store import Store


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranges_are_the_files(spark, tmp_path, small_splits):
    rng = np.random.default_rng(1)
    files = {"a": rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes(), "b": b"\n" * 9_000, "c": b"x" * 30_000, "d": b"one\r\ntwo", "e": b"\n", "f": b"end\n", "g": rng.integers(9, 14, 20_000, dtype=np.uint8).tobytes()}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    for step in (1_000, 1 << 20):
        got = ranges.byte_ranges(spark, f"file://{tmp_path}", step)
        found = {}
        for r in sorted(got.collect(), key=lambda r: (r.file, r.offset)):
            name = r.file.rsplit("/", 1)[1]
            assert r.offset == len(found.get(name, b""))
            found[name] = found.get(name, b"") + bytes(r.bytes)
        assert found == files
    by = {r.file.rsplit("/", 1)[1]: bytes(r.bytes) for r in ranges.aligned(ranges.byte_ranges(spark, f"file://{tmp_path}", 700), 1 << 16).collect()}
    assert by == files
    assert got.groupBy("file").count().count() == len(files) and ranges.byte_ranges(spark, f"file://{tmp_path}/a", 1_000).rdd.getNumPartitions() > 1


def _fasta(rng, n):
    """Records of many lengths, also longer than a range, lines broken anywhere."""
    out, text, length = [], "", int(rng.choice([5, 80, 9_000]))
    for k in range(n):
        body = "".join(rng.choice(list("ACGTacgt-"), length))
        out.append((f"s{k}", body.upper()))
        width = int(rng.integers(1, 70))
        text += f">s{k} more words\n" + "".join(body[a : a + width] + "\n" for a in range(0, len(body), width))
    return out, text.encode()


def test_archives_by_members(spark, tmp_path, small_splits):
    rng, want = np.random.default_rng(2), {}
    for k, packing in enumerate((zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED)):
        want[f"z{k}.zip"], body = _fasta(rng, 60)
        with zipfile.ZipFile(tmp_path / f"z{k}.zip", "w", packing) as z:
            z.writestr("dir/", "")
            z.writestr("notes.txt", rng.integers(0, 256, 7_000, dtype=np.uint8).tobytes())
            z.writestr("data/all.FASTA", body)
            z.writestr("after.txt", "x" * 3_000)
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        t.addfile(tarfile.TarInfo("fake.fa"), io.BytesIO(b""))
    for name, mode in (("t.tar", "w"), ("t.tar.gz", "w:gz")):
        want[name], body = _fasta(rng, 60)
        with tarfile.open(tmp_path / name, mode) as t:
            for member, data in (("inner.tar", inner.getvalue()), ("all.fa", body), ("last.txt", b"y" * 600)):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    for step in (2_048, 1 << 16):
        with Store(spark, "t") as store:
            got = prepare.archived_sequences(spark, f"file://{tmp_path}", store, step).collect()
            found = {}
            for r in sorted(got, key=lambda r: r.offset):
                found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.name, r.sequence))
            assert found == want


def test_archives_that_are_not_right(spark, tmp_path, small_splits):
    def zipped(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in members.items():
                z.writestr(member, text)
        return f"file://{tmp_path}/{name}"

    def read(path):
        with Store(spark, "t") as store:
            return prepare.archived_sequences(spark, path, store, 1_024).collect()

    for members, what in (({"a.fa": ">x\nA\n", "b.fa": ">y\nA\n"}, "not 2"), ({"a.txt": ""}, "not 0"), ({"a.fa": "A\n>x\nA\n"}, "before the first"), ({"a.fa": ">x\nA\n> \nA\n"}, "without name")):
        with pytest.raises(Exception, match=what):
            read(zipped("bad.zip", members))
    body = ">x\n" + "ACGT" * 5_000
    path = tmp_path / "cut.zip"
    zipped("cut.zip", {"a.fa": body})
    data = bytearray(path.read_bytes())
    data[data.index(b"a.fa") + 8] ^= 0x55
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="not whole|invalid|incorrect|Error"):
        read(f"file://{path}")
    with pytest.raises(Exception, match="no sequences"):
        read(zipped("empty.zip", {"a.fa": ""}))


def test_pieces_between_places(spark):
    data = bytes(range(256)) * 4
    rows = [("f", a, data[a : a + 100]) for a in range(0, len(data), 100)]
    held = spark.createDataFrame(rows, "file string, offset long, bytes binary")
    wanted = spark.createDataFrame([("f", "m1", 3, 950), ("f", "m2", 100, 200), ("f", "m3", 5, 5), ("g", "m4", 0, 10)], "file string, member string, begin long, end long")
    got = {}
    for r in sorted(ranges.pieces(held, wanted, 64).collect(), key=lambda r: r.offset):
        assert r.offset == r.begin + len(got.get(r.member, b""))
        got[r.member] = got.get(r.member, b"") + bytes(r.bytes)
    assert got == {"m1": data[3:950], "m2": data[100:200]}


def test_fasta_files_by_ranges(spark, tmp_path, small_splits):
    rng = np.random.default_rng(7)
    want = {}
    for name in ("a.fa", "b.fa"):
        want[name], body = _fasta(rng, 50)
        (tmp_path / name).write_bytes(body if name == "a.fa" else body.replace(b"\n", b"\r\n")[:-2])
    for step in (300, 1 << 20):
        with Store(spark, "t") as store:
            found = {}
            for r in sorted(ranges.fasta_files(spark, f"file://{tmp_path}", store, step).collect(), key=lambda r: r.offset):
                found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.name, r.sequence))
                assert (tmp_path / r.file.rsplit("/", 1)[1]).read_bytes()[r.offset :].startswith(b">" + r.name.encode())
            assert found == want
