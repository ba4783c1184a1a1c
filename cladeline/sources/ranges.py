"""Files of any kind by byte ranges, and archives by members, from every store that Spark reads; no file is a cell or one task's work.

Spark's text reader cuts a file at line feeds wherever they are and hands on bytes as they stand, by splits.  Joined
again they are the file's bytes, and the sums of the splits before tell where they lie.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lines import carry_forward
from .store import Store

#: Bytes of a range, about.
STEP = 1 << 20
#: Fixed values of the formats.
ZIP_END, ZIP_ENTRY, ZIP_LOCAL, ZIP64_END, ZIP64_AT = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x06\x06", b"PK\x06\x07"
STORED, DEFLATED = 0, 8
TAR_BLOCK = 512

_RANGES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])


def _joined(step: int):
    """Rows (file, start of the split, bytes of a line without its feed) in order -> ranges of a split, by their distance from its first byte."""

    def run(batches):
        key, at, held, size = None, 0, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, at, b"".join(held)), _RANGES, strict=True)], schema=_RANGES)

        for batch in batches:
            for file, start, line in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("line"), strict=True):
                if (file, start) != key:
                    if held:
                        yield out()
                    key, at, held, size = (file, start), 0, [], 0
                data = line.as_buffer().to_pybytes()
                for a in range(0, len(data) + 1, step):
                    part = data[a : a + step]
                    held.append(part if a + step <= len(data) else part + b"\n")
                    size += len(held[-1])
                    if size >= step:
                        yield out()
                        at, held, size = at + size, [], 0
        if held:
            yield out()

    return run


def byte_ranges(spark: SparkSession, path: str | list[str], step: int = STEP) -> DataFrame:
    """file, offset, bytes: the files' contents in ranges of about ``step`` bytes.

    A file whose name says that it is compressed as a whole (.gz, .bz2) is unpacked by the reader, in one task.  An empty file has no range.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(*where, F.col("value").cast("binary").alias("line"))
    splits = rows.groupBy("file", "start", "size").agg(F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))
    by_file = W.partitionBy("file").orderBy("start")
    above = F.sum("bytes").over(by_file.rowsBetween(W.unboundedPreceding, -1))
    splits = splits.withColumn("first", F.coalesce(above, F.lit(0))).withColumn("whole", F.sum("bytes").over(W.partitionBy("file")))
    # the feed after the last line need not be there
    packed = F.col("file").rlike(r"\.(gz|bz2|zst|deflate|lz4|snappy)$")
    odd = ~packed & ((F.col("whole") - F.col("size")) > 1) | (~packed & (F.col("whole") < F.col("size")))
    end = F.when(odd, F.raise_error(F.concat(F.lit("not all bytes were read of "), F.col("file"))).cast("long")).when(packed, F.col("whole")).otherwise(F.col("size"))
    splits = splits.select(F.col("file").alias("f"), F.col("start").alias("s"), "first", end.alias("end"))
    ranges = rows.select("file", "start", "line").mapInArrow(_joined(step), "file string, start long, at long, bytes binary")
    placed = ranges.join(splits, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))).withColumn("offset", F.col("at") + F.col("first"))
    fits = F.least(F.octet_length("bytes").cast("long"), F.col("end") - F.col("offset"))
    return placed.select("file", "offset", F.when(fits < F.octet_length("bytes"), F.expr("substring(bytes, 1, CAST(end - offset AS INT))")).otherwise(F.col("bytes")).alias("bytes")).where("octet_length(bytes) > 0")


def pieces(ranges: DataFrame, wanted: DataFrame, step: int = STEP) -> DataFrame:
    """wanted (file, begin, end and other columns) -> its columns and offset, bytes of every range's part that lies between them."""
    cells = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {step}"), F.expr(f"({b}) div {step}")))
    left = ranges.select(F.col("file").alias("f"), "offset", (F.col("offset") + F.octet_length("bytes")).alias("stop"), "bytes").withColumn("cell", cells("offset", "stop - 1"))
    right = wanted.where("end > begin").withColumn("at", cells("begin", "end - 1"))
    # where a range and a member share several cells, they meet at the first
    first = F.greatest(F.expr(f"offset div {step}"), F.expr(f"begin div {step}"))
    met = left.join(right, (F.col("f") == F.col("file")) & (F.col("cell") == F.col("at"))).where((F.col("offset") < F.col("end")) & (F.col("stop") > F.col("begin")) & (F.col("cell") == first))
    cut = F.expr("substring(bytes, CAST(greatest(begin - offset, 0) + 1 AS INT), CAST(least(end, stop) - greatest(begin, offset) AS INT))")
    return met.select(*wanted.columns, F.greatest("offset", "begin").alias("offset"), cut.alias("bytes"))


def _bytes(rows: pa.Table) -> tuple[int, bytes]:
    """First offset and bytes of neighbouring ranges."""
    rows = rows.sort_by("offset")
    return rows.column("offset")[0].as_py(), b"".join(x.as_py() for x in rows.column("bytes"))


_MEMBERS = "file string, member string, begin long, end long, method int, size long, crc long"
_MEMBER_NAMES = [x.split()[0] for x in _MEMBERS.split(", ")]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=_MEMBER_NAMES)


def _directory(rows: pa.Table) -> pa.Table:
    """The last ranges of a zip archive -> file, begin and end of its central directory."""
    at, data = _bytes(rows)
    end = data.rfind(ZIP_END)
    found = []
    if end >= 0 and end + 22 <= len(data) and end + 22 + struct.unpack_from("<H", data, end + 20)[0] == len(data):
        size, begin = struct.unpack_from("<II", data, end + 12)
        locator = end - 20
        if begin == 0xFFFFFFFF and locator >= 0 and data[locator : locator + 4] == ZIP64_AT:
            where = struct.unpack_from("<Q", data, locator + 8)[0] - at
            if 0 <= where and data[where : where + 4] == ZIP64_END:
                size, begin = struct.unpack_from("<QQ", data, where + 40)
        found = [(rows.column("file")[0].as_py(), begin, begin + size)]
    return pa.table([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "begin", "end"])


def _entries(rows: pa.Table) -> pa.Table:
    """The central directory of an archive -> its members, each from its local header on."""
    file, (_, data), found, at = rows.column("file")[0].as_py(), _bytes(rows), [], 0
    while data[at : at + 4] == ZIP_ENTRY:
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, size, name, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        place = struct.unpack_from("<I", data, at + 42)[0]
        label = data[at + 46 : at + 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
        more, stop = at + 46 + name, at + 46 + name + extra
        while more + 4 <= stop:
            kind, length = struct.unpack_from("<HH", data, more)
            if kind == 1:  # sizes and places beyond 32 bits, those that are, in this order
                values = iter(struct.unpack_from(f"<{length // 8}Q", data, more + 4))
                size = next(values) if size == 0xFFFFFFFF else size
                packed = next(values) if packed == 0xFFFFFFFF else packed
                place = next(values) if place == 0xFFFFFFFF else place
            more += 4 + length
        if not label.endswith("/"):
            found.append((file, label, place, place + 30 + packed, method, size, crc))
        at = stop + comment
    return _table(found)


def _number(field: bytes) -> int:
    """An octal or, with the first bit set, binary number; -1 if it is neither."""
    if field[0] & 0x80:
        return int.from_bytes(field) & ((1 << (8 * len(field) - 1)) - 1)
    text = field.split(b"\0")[0].strip()
    return int(text, 8) if re.fullmatch(rb"[0-7]+", text) else -1


def _headers(batches):
    """Aligned ranges of tar archives -> blocks that are headers by their sums: file, offset, kind, name, size.  What a member holds may look like one too."""
    for batch in batches:
        rows = []
        for file, offset, cell in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("bytes"), strict=True):
            data = np.frombuffer(cell.as_buffer(), np.uint8)
            blocks = data[: len(data) // TAR_BLOCK * TAR_BLOCK].reshape(-1, TAR_BLOCK)
            for k in np.flatnonzero((blocks[:, 257:262] == np.frombuffer(b"ustar", np.uint8)).all(axis=1)).tolist():
                block = blocks[k].tobytes()
                if sum(block) - sum(block[148:156]) + 256 != _number(block[148:156]) or _number(block[124:136]) < 0:
                    continue
                prefix = block[345:500].split(b"\0")[0] if block[257:263] == b"ustar\0" else b""
                name = block[:100].split(b"\0")[0]
                rows.append((file, offset + k * TAR_BLOCK, block[156:157].decode("latin-1"), ((prefix + b"/" if prefix else b"") + name).decode("utf-8", "replace"), _number(block[124:136])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "offset", "kind", "name", "size"])


def _chain(rows: pa.Table) -> pa.Table:
    """The headers of an archive -> its members: from the first on, each begins where the one before it ends."""
    rows = rows.sort_by("offset").to_pylist()
    at, found = 0, []
    for row in rows:
        if row["offset"] != at:
            continue
        begin = at + TAR_BLOCK
        at = begin + -(-row["size"] // TAR_BLOCK) * TAR_BLOCK
        if row["kind"] in ("0", "\0", "7"):  # a longer name in a block before it is not looked into
            found.append((row["file"], row["name"], begin, begin + row["size"], STORED, row["size"], None))
    return _table(found)


def aligned(ranges: DataFrame, step: int = STEP) -> DataFrame:
    """Ranges that begin at multiples of ``step``, so that no block of a power of two up to it lies across two."""
    grid = ranges.select("file", F.explode(F.sequence(F.expr(f"offset div {step}"), F.expr(f"(offset + octet_length(bytes) - 1) div {step}"))).alias("cell"), "offset", "bytes")
    begin = F.greatest(F.col("offset"), F.col("cell") * step)
    cut = F.expr(f"substring(bytes, CAST(greatest(cell * {step} - offset, 0) + 1 AS INT), CAST(least(offset + octet_length(bytes), (cell + 1) * {step}) - greatest(offset, cell * {step}) AS INT))")
    parts = grid.select("file", "cell", begin.alias("offset"), cut.alias("bytes"))
    whole = F.array_sort(F.collect_list(F.struct("offset", "bytes")))
    return parts.groupBy("file", "cell").agg(whole.alias("p")).select("file", F.col("p")[0]["offset"].alias("offset"), F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"])).alias("bytes"))


def members(ranges: DataFrame, step: int = STEP) -> DataFrame:
    """file, member, begin, end, method, size, crc of the archives' files: zip by their central directories, tar by the chain of headers.

    For zip, begin is that of the local header.  What is neither has no members.
    """
    ends = ranges.groupBy("file").agg(F.max(F.col("offset") + F.octet_length("bytes")).alias("stop"))
    tail = pieces(ranges, ends.select("file", F.greatest(F.lit(0), F.col("stop") - (1 << 17)).alias("begin"), F.col("stop").alias("end")), step)
    directory = tail.groupBy("file").applyInArrow(_directory, "file string, begin long, end long")
    zipped = pieces(ranges, directory, step).groupBy("file").applyInArrow(_entries, _MEMBERS)
    headers = aligned(ranges, step).mapInArrow(_headers, "file string, offset long, kind string, name string, size long")
    return zipped.unionByName(headers.groupBy("file").applyInArrow(_chain, _MEMBERS))


def _unpacked(batches) -> Iterator[pa.RecordBatch]:
    """Pieces of members in order -> file, member, offset (in the member), bytes; a member's sum is checked at its end."""
    names, key, state = ["file", "member", "offset", "bytes"], None, None

    def row(data: bytes) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state["at"], data), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=names)
        state["at"], state["crc"] = state["at"] + len(data), zlib.crc32(data, state["crc"])
        return out

    def ended() -> None:
        if state["at"] != state["size"] or state["want"] is not None and state["crc"] != state["want"]:
            raise ValueError(f"member {key[1]} of {key[0]} is not whole")

    for batch in batches:
        for x in batch.to_pylist():
            if (x["file"], x["member"]) != key:
                if key is not None:
                    ended()
                key, state = (x["file"], x["member"]), {"at": 0, "crc": 0, "size": x["size"], "want": x["crc"], "skip": None if x["crc"] is not None else 0, "head": b"", "left": None}
                state["open"] = zlib.decompressobj(-15) if x["method"] == DEFLATED else None
                if x["method"] not in (STORED, DEFLATED):
                    raise ValueError(f"member {x['member']} is packed by method {x['method']}")
            data = x["bytes"]
            if state["skip"] is None:  # a zip member's local header has lengths of its own
                state["head"] += data
                if len(state["head"]) < 30:
                    continue
                if state["head"][:4] != ZIP_LOCAL:
                    raise ValueError(f"member {x['member']} has no header")
                state["skip"] = 30 + sum(struct.unpack_from("<HH", state["head"], 26))
                data, state["head"] = state["head"], b""
            cut = min(state["skip"], len(data))
            data, state["skip"] = data[cut:], state["skip"] - cut
            if state["open"] is None:
                data = data[: state["size"] - state["at"]]
                if data:
                    yield row(data)
                continue
            while data and not state["open"].eof:
                part = state["open"].decompress(data, STEP)
                data = state["open"].unconsumed_tail
                if part:
                    yield row(part)
    if key is not None:
        ended()


def unpacked(ranges: DataFrame, wanted: DataFrame, step: int = STEP) -> DataFrame:
    """file, member, offset, bytes of members' contents.

    A deflated member is unpacked as a stream, in one task that holds one piece; pieces of stored members, as all of tar are, stay where they are.
    """
    # lengths in the local header are not known before it is read: 64 KiB of names and 64 KiB of extras at most
    reach = F.when(F.col("crc").isNotNull(), F.col("end") + (1 << 17)).otherwise(F.col("end"))
    streamed = pieces(ranges, wanted.where("crc IS NOT NULL").withColumn("end", reach), step)
    streamed = streamed.select("file", "member", "begin", "method", "size", "crc", "offset", "bytes").repartition("file", "member").sortWithinPartitions("file", "member", "offset").mapInArrow(_unpacked, "file string, member string, offset long, bytes binary")
    plain = pieces(ranges, wanted.where("crc IS NULL"), step).select("file", "member", (F.col("offset") - F.col("begin")).alias("offset"), "bytes")
    return streamed.unionByName(plain)


def _records(batches):
    """Pieces of FASTA text -> what stands before the first header in each (kind 0), and each header with the text up to the next (kind 1)."""
    names = ["file", "member", "at", "kind", "text"]
    for batch in batches:
        for x in batch.to_pylist():
            data, offset = x["bytes"], x["offset"]
            starts = [m.start() + 1 for m in re.finditer(rb"\n>", data)]
            if data[:1] == b">":  # a header if the piece before ends a line, which the joining tells
                starts.insert(0, 0)
            cuts = [0, *[s for s in starts if s], len(data)]
            rows = [(x["file"], x["member"], offset + a, int(a > 0 or (a == 0 and offset == 0 and data[:1] == b">")), data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=names)


def fasta_members(contents: DataFrame) -> DataFrame:
    """contents (file, member, offset, bytes in pieces), a written table -> file, member, offset, name, sequence of their FASTA records.

    A record that lies in several pieces is put together from them; only its own pieces meet.  A piece that begins with ``>`` begins a
    record if the piece before it ends a line.  Text before the first record, and a record without a name, are errors.
    """
    parts = contents.mapInArrow(_records, "file string, member string, at long, kind int, text binary")
    ends = contents.where("substring(bytes, -1, 1) = X'0A'").select("file", "member", (F.col("offset") + F.octet_length("bytes")).alias("at"), F.lit(1).alias("fresh"))
    open_ = (F.col("kind") == 0) & F.expr("substring(text, 1, 1) = X'3E'")
    parts = parts.where(~open_).withColumn("fresh", F.col("kind")).unionByName(parts.where(open_).join(ends, ["file", "member", "at"], "left"))
    held = carry_forward(parts, ["file", "member"], "at", F.when(F.col("fresh") == 1, F.col("at")), "header", 64 * STEP)
    whole = held.groupBy("file", "member", "header").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    text = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["text"])).cast("string")
    rows = whole.select("file", "member", F.col("header").alias("offset"), text.alias("text"))
    name = F.regexp_extract(F.regexp_extract("text", r"^>([^\r\n]*)", 1), r"^\s*(\S+)", 1)
    wrong = lambda what: F.raise_error(F.lit(what)).cast("string")
    early = F.col("offset").isNull()
    rows = rows.withColumn("name", F.when(early & F.col("text").rlike(r"\S"), wrong("FASTA text before the first header")).when(early, F.lit(None)).when(name == "", wrong("a sequence without name")).otherwise(name))
    sequence = F.upper(F.regexp_replace(F.regexp_replace("text", r"^>[^\n]*(\n|$)", ""), r"\s+", ""))
    return rows.where("name IS NOT NULL").select("file", "member", "offset", "name", sequence.alias("sequence"))


def fasta_files(spark: SparkSession, path: str | list[str], store: Store, step: int = STEP) -> DataFrame:
    """file, offset, name, sequence of FASTA files, read by ranges: of any size, from any store."""
    held = store.put(byte_ranges(spark, path, step).select("file", F.col("file").alias("member"), "offset", "bytes"), "ranges")
    return fasta_members(held).drop("member")
