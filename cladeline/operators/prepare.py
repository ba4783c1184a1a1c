"""Turning alignments and archives into inputs: archives, labels, weights, two-pass column selection."""

from __future__ import annotations

import hashlib
import io
import tarfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.randomness import Stream
from ..sources import ranges
from ..sources.store import Store
from ..sources.text import parse_newick, write_newick

def tar_of(members: dict[str, bytes], mode: str = "w:gz") -> bytes:
    """A tar archive, compressed unless mode is ``w``."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def one_fasta(members: DataFrame) -> DataFrame:
    """The one FASTA member of each archive; none, or several, are errors."""
    found = members.withColumn("fasta", F.col("member").rlike(r"(?i)\.(fa|fas|fasta|fna)$"))
    counts = found.groupBy("file").agg(F.count_if("fasta").alias("n"))
    wrong = F.raise_error(F.concat(F.lit("an archive has one FASTA member, not "), F.col("n").cast("string"), F.lit(": "), F.col("file")))
    right = counts.select(F.when(F.col("n") == 1, F.col("file")).otherwise(wrong).alias("file"))
    return found.where("fasta").drop("fasta").join(right, "file")


def archived_sequences(spark: SparkSession, path: str | list[str], store: Store, step: int = ranges.STEP) -> DataFrame:
    """file, member, offset, name, sequence of the one FASTA member of each zip or tar archive under a path that Spark reads.

    Archives and members of any size: the files are read by ranges, directories and headers tell where members lie, and records are put together
    from the pieces that they lie in.  A deflated member is unpacked by one task, as a stream; a tar.gz by its reader.
    A member without records, sequences of different lengths or of none, and characters that are no codes are errors.
    """
    held = store.put(ranges.byte_ranges(spark, path, step), "ranges")
    members = store.put(one_fasta(ranges.members(held, step)), "members")
    records = store.put(ranges.fasta_members(store.put(ranges.unpacked(held, members, step), "contents")), "records")
    return aligned_records(records, members.select("file"))


def aligned_records(records: DataFrame, files: DataFrame) -> DataFrame:
    """records (file, ..., sequence) of the files, if each has some, all of one length above 0 and of known codes; else an error."""
    size = F.length("sequence")
    sizes = records.groupBy("file").agg(F.min(size).alias("least"), F.max(size).alias("most"), F.bool_and(F.col("sequence").rlike("^[ACMGRSVTWYHKDBUNX?.-]*$")).alias("known"))
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("file")))
    right = files.join(sizes, "file", "left").select(F.when(F.col("least").isNull(), wrong("no sequences")).when(F.col("least") == 0, wrong("a sequence without characters")).when(F.col("least") < F.col("most"), wrong("sequences of different lengths")).when(~F.col("known"), wrong("a character that is no code")).otherwise(F.col("file")).alias("file"))
    return right.join(records, "file", "left")  # from this side, so that faults count without any record too


def pattern_weights(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """pattern, weight of a file of positive whole numbers, exactly ``expected`` of them."""
    words = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("pattern", "word"))
    rows = words.select("pattern", F.when(F.col("word").rlike("^[1-9][0-9]*$"), F.col("word").cast("long")).otherwise(F.raise_error(F.concat(F.lit("no weight: "), "word")).cast("long")).alias("weight"))
    n = rows.count()
    if n != expected:
        raise ValueError(f"{n} weights, not {expected}")
    return rows


def cut_labels(text: str, codec: str = "iso-8859-1") -> str:
    """A tree whose leaf labels are cut at the first comma; comments go, other bytes of the labels with them.

    ``text`` may be bytes of any single-byte code.
    """
    if isinstance(text, bytes):
        text = text.decode(codec)
    nodes = parse_newick(text)
    parents = {p for _, p, _, _ in nodes}
    return write_newick([(n, p, label.split(",")[0].strip() if n not in parents else label, x) for n, p, label, x in nodes])


def _shortest_17():
    """Column function: 17 significant digits, as printf's %.17g writes them; the JVM's formatter has no such form."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else format(v, ".17g"))

    return run


def canonical_dataset(name: Column) -> Column:
    """The end of a synthetic identity in one spelling: two counts without leading zeros, the height with 17 significant digits.

    Names that do not end so stay as they are.
    """
    pattern = r"^(synthetic-jc69-?.*?)-([+-]?[0-9]+)-([+-]?[0-9]+)-([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    count = lambda k: part(k).try_cast("long").cast("string")
    spelt = F.concat_ws("-", part(1), count(2), count(3), _shortest_17()(part(4).try_cast("double")))
    return F.when(part(2) != "", spelt).otherwise(name)


#: Part of the identity of kept statistics: another way to count needs another number.
STATISTICS_VERSION = 2
#: Columns that travel as one packed row.
BLOCK = 1 << 16


def _codes() -> np.ndarray:
    """The states (1 to 15) that a byte of a sequence allows, as encode.decode() has them; 0 for what is no code."""
    out = np.zeros(256, np.uint8)
    for k, letter in enumerate("ACMGRSVTWYHKDB", 1):
        out[ord(letter)] = out[ord(letter.lower())] = k
    for letter in "Uu":
        out[ord(letter)] = 8
    for letter in "NnXx?-.":
        out[ord(letter)] = 15
    return out


def _columns_of(block: int):
    """Sequences -> for each block of columns, how many cells have one state, and which states those are."""

    def run(batches):
        code, covered, states = _codes(), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for batch in batches:
            for cell in batch.column("sequence"):
                if not cell.is_valid:
                    continue
                own = code[np.frombuffer(cell.as_buffer(), np.uint8)]
                if not own.all():
                    raise ValueError("a sequence holds what is no code")
                if len(own) > len(covered):
                    covered, states = np.pad(covered, (0, len(own) - len(covered))), np.pad(states, (0, len(own) - len(states)))
                one = (own & (own - 1)) == 0
                covered[: len(own)] += one
                states[: len(own)] |= np.where(one, own, np.uint8(0))
        for a in range(0, len(covered), block):
            yield pa.RecordBatch.from_arrays([pa.array([a // block], pa.int64()), pa.array([covered[a : a + block].tobytes()], pa.binary()), pa.array([states[a : a + block].tobytes()], pa.binary())], names=["block", "covered", "states"])

    return run


def _merged(block: int):
    """The packed rows of one block -> site, covered, states, variable."""

    def run(rows: pa.Table) -> pa.Table:
        most = max(len(x.as_buffer()) for x in rows.column("states"))
        covered, states = np.zeros(most, np.int64), np.zeros(most, np.uint8)
        for c, s in zip(rows.column("covered"), rows.column("states"), strict=True):
            n = len(s.as_buffer())
            covered[:n] += np.frombuffer(c.as_buffer(), np.int64)
            states[:n] |= np.frombuffer(s.as_buffer(), np.uint8)
        site = rows.column("block")[0].as_py() * block + np.arange(most)
        return pa.table([pa.array(site), pa.array(covered), pa.array(states.astype(np.int32)), pa.array(np.bitwise_count(states) > 1)], names=["site", "covered", "states", "variable"])

    return run


def _bits(block: int):
    """The kept columns of one block, a bit for each of its columns."""

    def run(rows: pa.Table) -> pa.Table:
        number, mark = rows.column("block")[0].as_py(), np.zeros(block, bool)
        mark[rows.column("site").to_numpy() - number * block] = True
        return pa.table([pa.array([number], pa.int64()), pa.array([np.packbits(mark).tobytes()], pa.binary())], names=["block", "bits"])

    return run


def column_statistics(sequences: DataFrame) -> DataFrame:
    """site, covered, states, variable of the columns of aligned sequences (name, sequence).

    A task adds up vectors of its sequences and sends one packed row for each BLOCK of columns; no cell becomes a row.
    Shorter sequences have no cells beyond their end, null ones none; a character that is no code is an error.
    """
    packed = sequences.select("sequence").mapInArrow(_columns_of(BLOCK), "block long, covered binary, states binary")
    return packed.groupBy("block").applyInArrow(_merged(BLOCK), "site long, covered long, states int, variable boolean")


def statistics_identity(sequences: DataFrame, member: str = "") -> tuple[str, int]:
    """(name under which the statistics of just these sequences are kept, how many sequences there are)."""
    row = F.xxhash64("name", "sequence")
    n, a, b = sequences.agg(F.count("*"), F.bit_xor(row), F.sum(F.hash("sequence", "name").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((STATISTICS_VERSION, member, n, a, str(b))).encode()).hexdigest()[:32], int(n)


def two_pass(sequences: DataFrame, fraction: float, checkpoint: str, member: str = "") -> tuple[DataFrame, DataFrame]:
    """(retained columns, sequences over them): a column stays if at least ceil(fraction * taxa) cells have one state.

    The first pass's statistics are kept under ``checkpoint``, by version, member and digest of the sequences, and are used
    again for the same input only.  The second pass gathers each sequence's kept bytes; the kept columns travel as one bit each.
    """
    spark = sequences.sparkSession
    key, taxa = statistics_identity(sequences, member)
    path = f"{checkpoint}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        column_statistics(sequences).write.mode("overwrite").parquet(path)
    kept = spark.read.schema("site long, covered long, states int, variable boolean").parquet(path).where(F.col("covered") >= F.ceil(F.lit(fraction) * taxa))
    packed = kept.select(F.expr(f"site div {BLOCK}").alias("block"), "site").groupBy("block").applyInArrow(_bits(BLOCK), "block long, bits binary")
    bits = {r["block"]: r["bits"] for r in packed.collect()}  # an eighth of one sequence's cell, at most
    empty = bytes(BLOCK // 8)
    sent = spark.sparkContext.broadcast(np.frombuffer(b"".join(bits.get(k, empty) for k in range(max(bits, default=-1) + 1)), np.uint8))

    def gather(batches):
        at = np.flatnonzero(np.unpackbits(sent.value))
        for batch in batches:
            cells = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else None for x in batch.column("sequence")]
            cut = [None if c is None else c[at[: np.searchsorted(at, len(c))]].tobytes().decode("ascii") for c in cells]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(cut, pa.string())], names=["name", "sequence"])

    return kept.orderBy("site"), sequences.select("name", "sequence").mapInArrow(gather, "name string, sequence string")


def simulate_by_depth(nodes: list[tuple[int, int | None, str, float]], sites: int, seed: int) -> dict[str, str]:
    """Leaf label -> sequence under Jukes-Cantor: the root's sites are drawn first, then edge by edge a node's sites,
    edges by the preorder of their parents and the last child first.

    A site keeps its parent's state with probability 1/4 + 3/4 exp(-4t/3) and else takes one of the other three by a
    further draw.  ``nodes`` are in preorder, as parsers give them.
    """
    rng, inner = Stream(seed), {p for _, p, _, _ in nodes}
    states = {nodes[0][0]: np.array([rng.below(4) for _ in range(sites)], np.int8)}
    for node, parent, _, length in sorted(nodes[1:], key=lambda n: (n[1], -n[0])):
        above, keep = states[parent], 0.25 + 0.75 * float(np.exp(-4.0 * length / 3.0))
        step = np.fromiter((0 if rng.unit() < keep else 1 + rng.below(3) for _ in range(sites)), np.int8, sites)
        states[node] = (above + step) % 4
    letters = np.frombuffer(b"ACGT", np.uint8)
    return {label: letters[states[node]].tobytes().decode() for node, _, label, _ in nodes if node not in inner}
