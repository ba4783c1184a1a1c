"""Readers of tree and alignment text, and Spark data sources over them.

The parsers work on whole texts with explicit stacks, so depth is bounded by memory only.  Errors name the
offset at which they arise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# IUPAC codes by mask, A = 1, C = 2, G = 4, T = 8.
MASK_CODES = "-ACMGRSVTWYHKDBN"
UNKNOWN = "NX?-."

TREE_NODES = "tree_id string, node_id int, parent_id int, label string, branch_length double"
SEQUENCES = "alignment_id string, record_idx int, name string, sequence string"

_LENGTH = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_BARE = re.compile(r"[^\s()\[\]{}':;,]+")


class ParseError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at offset {at}")
        self.at = at


def _blank(text: str, at: int) -> int:
    """Past white space and comments, which may nest."""
    n = len(text)
    while at < n:
        if text[at].isspace():
            at += 1
        elif text[at] == "[":
            start, depth = at, 0
            while True:
                if at >= n:
                    raise ParseError("comment without end", start)
                depth += (text[at] == "[") - (text[at] == "]")
                at += 1
                if depth == 0:
                    break
        else:
            break
    return at


def _label(text: str, at: int) -> tuple[str, int]:
    if at < len(text) and text[at] == "'":
        start, out = at, []
        at += 1
        while True:
            end = text.find("'", at)
            if end < 0:
                raise ParseError("quoted label without end", start)
            out.append(text[at:end])
            at = end + 1
            if at < len(text) and text[at] == "'":
                out.append("'")
                at += 1
            else:
                return "".join(out), at
    m = _BARE.match(text, at)
    return (m[0], m.end()) if m else ("", at)


def parse_newick(text: str) -> list[tuple[int, int | None, str, float]]:
    """(node, parent, label, length) in preorder, the root 0 with parent None.  A missing length is 0."""
    nodes: list[list] = []
    stack: list[int] = []
    at, fresh = _blank(text, 0), True  # fresh: a subtree must begin here
    while True:
        at = _blank(text, at)
        if at >= len(text):
            raise ParseError("tree without ;", at)
        c = text[at]
        if fresh:
            nodes.append([len(nodes), stack[-1] if stack else None, "", 0.0])
            node = len(nodes) - 1
            if c == "(":
                stack.append(node)
                at += 1
                continue
            label, end = _label(text, at)
            if not label:
                raise ParseError("leaf without label", at)
            nodes[node][2], at, fresh = label, end, False
            at = _tail(text, at, nodes[node])
        elif c == "," and stack:
            at, fresh = at + 1, True
        elif c == ")" and stack:
            node = stack.pop()
            at = _blank(text, at + 1)
            nodes[node][2], at = _label(text, at)
            at = _tail(text, at, nodes[node])
        elif c == ";" and not stack:
            if _blank(text, at + 1) < len(text):
                raise ParseError("text behind the tree", at + 1)
            return [tuple(x) for x in nodes]
        else:
            raise ParseError(f"unexpected {c!r}", at)


def _tail(text: str, at: int, node: list) -> int:
    after = _blank(text, at)
    if after < len(text) and text[after] == ":":
        after = _blank(text, after + 1)
        m = _LENGTH.match(text, after)
        if not m or not math.isfinite(float(m[0])) or float(m[0]) < 0:
            raise ParseError("a length must be a finite number that is not negative", after)
        node[3] = float(m[0])
        return m.end()
    return after


def _known(sequence: str, at: int) -> str:
    for c in sequence:
        if c.upper() not in "ACGTURYSWKMBDHVNX?-.":
            raise ParseError(f"no nucleotide code: {c!r}", at)
    return sequence


def _alike(records: list[tuple[str, str]], least: int) -> list[tuple[int, str, str]]:
    if len(records) < least:
        raise ParseError(f"{least} sequences are needed", 0)
    if len({name for name, _ in records}) < len(records):
        raise ParseError("a name occurs twice", 0)
    if len({len(s) for _, s in records}) > 1 or not records[0][1]:
        raise ParseError("sequences must be of one length, and not empty", 0)
    return [(k, name, s) for k, (name, s) in enumerate(records)]


def parse_fasta(text: str, rna: bool = False, least: int = 1) -> list[tuple[int, str, str]]:
    """(record, name, sequence): upper case, white space dropped; ``rna`` turns U into T."""
    records: list[tuple[str, list[str]]] = []
    at = 0
    for line in text.splitlines(keepends=True):
        body = line.strip()
        if body.startswith(">"):
            name = body[1:].split()
            if not name:
                raise ParseError("sequence without name", at)
            records.append((name[0], []))
        elif body:
            if not records:
                raise ParseError("text before the first header", at)
            records[-1][1].append(_known("".join(body.split()).upper(), at))
        at += len(line)
    joined = [(name, "".join(parts)) for name, parts in records]
    return _alike([(n, s.replace("U", "T") if rna else s) for n, s in joined], least)


def fasta_records(lines) -> Iterator[tuple[str, str]]:
    """(name, sequence) of lines of bytes, one record held at a time; upper case, white space dropped, letters checked.

    All sequences must be of one length.  Names that occur twice are for the caller to find: they are not held here.
    """
    name, parts, length, at = None, [], None, 0

    def whole():
        nonlocal length
        sequence = "".join(parts)
        if not sequence or length not in (None, len(sequence)):
            raise ParseError("sequences must be of one length, and not empty", at)
        length = len(sequence)
        return name, sequence

    for line in lines:
        body = line.decode().strip()
        if body.startswith(">"):
            if name is not None:
                yield whole()
            words = body[1:].split()
            if not words:
                raise ParseError("sequence without name", at)
            name, parts = words[0], []
        elif body:
            if name is None:
                raise ParseError("text before the first header", at)
            parts.append(_known("".join(body.split()).upper(), at))
        at += len(line)
    if name is None:
        raise ParseError("no sequences", at)
    yield whole()


def parse_phylip(text: str, least: int = 1) -> list[tuple[int, str, str]]:
    """(record, name, sequence) of relaxed sequential or interleaved PHYLIP; later blocks may repeat the names."""
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    head = lines[0].split() if lines else []
    if len(head) != 2 or not all(x.isdigit() and int(x) > 0 for x in head):
        raise ParseError("a header has two counts above zero", 0)
    taxa, sites = map(int, head)
    if len(lines) - 1 < taxa:
        raise ParseError("fewer records than the header says", 0)
    names, parts = [], []
    for line in lines[1 : taxa + 1]:
        name, *rest = line.split()
        names.append(name)
        parts.append(["".join(rest)])
    for k, line in enumerate(lines[taxa + 1 :]):
        words = line.split()
        if len(words) > 1 and words[0] == names[k % taxa]:
            words = words[1:]
        parts[k % taxa].append("".join(words))
    records = [(n, _known("".join(p).upper(), 0)) for n, p in zip(names, parts, strict=True)]
    for name, s in records:
        if len(s) != sites:
            raise ParseError(f"{name} has {len(s)} sites, not {sites}", 0)
    return _alike(records, least)


def write_newick(nodes: list[tuple[int, int | None, str, float]]) -> str:
    """The inverse of parse_newick."""
    kids: dict[int | None, list[int]] = {}
    for node, parent, _, _ in nodes:
        kids.setdefault(parent, []).append(node)
    by_id = {n[0]: n for n in nodes}
    out, stack = [], [(kids[None][0], 0)]
    while stack:
        node, k = stack.pop()
        own = kids.get(node, [])
        if own and k == 0:
            out.append("(")
        if k < len(own):
            if k:
                out.append(",")
            stack += [(node, k + 1), (own[k], 0)]
            continue
        if own:
            out.append(")")
        _, parent, label, length = by_id[node]
        out.append("'" + label.replace("'", "''") + "'" if label and not _BARE.fullmatch(label) else label)
        if parent is not None:
            out.append(f":{length!r}")
    return "".join(out) + ";"


def wrap_fasta(sequences: DataFrame, width: int = 80) -> DataFrame:
    """name, sequence -> value: FASTA lines of ``width`` letters, one row a record."""
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value"))


def parse_pandit(text: str) -> list[dict]:
    """Families of a tagged flat file: family, tree, mask and named sequences; // ends a family."""
    out, now = [], {"family": "", "tree": "", "mask": "", "sequences": []}
    for line in text.splitlines():
        tag, _, body = line.partition(" ")
        body = body.strip()
        if tag == "//":
            if now["family"]:
                out.append(now)
            now = {"family": "", "tree": "", "mask": "", "sequences": []}
        elif tag == "FAM":
            now["family"] = body
        elif tag == "DPH":
            now["tree"] += body
        elif tag == "DMK":
            now["mask"] += body
        elif tag == "NAM":
            now["sequences"].append([body, ""])
        elif tag == "DSQ" and now["sequences"]:
            now["sequences"][-1][1] += body
    return out


def masked(sequence: str, mask: str) -> str:
    """The columns marked x."""
    return "".join(c for c, m in zip(sequence, mask, strict=True) if m == "x")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file, read by Spark and so from any store it knows."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _parsed(texts: DataFrame, parse, schema: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(path, *row) for path, text in zip(pdf["path"], pdf["text"], strict=True) for row in parse(text)]
            names = [c.split()[0] for c in schema.split(",")]
            yield pd.DataFrame(rows, columns=[n.strip() for n in names]).astype(object) if rows else pd.DataFrame({n.strip(): [] for n in names})

    return texts.mapInPandas(run, schema)


def newick_nodes(texts: DataFrame) -> DataFrame:
    return _parsed(texts, parse_newick, TREE_NODES)


def fasta_sequences(texts: DataFrame) -> DataFrame:
    return _parsed(texts, parse_fasta, SEQUENCES)


def phylip_sequences(texts: DataFrame) -> DataFrame:
    return _parsed(texts, parse_phylip, SEQUENCES)


def faults(texts: DataFrame, parse) -> DataFrame:
    """text, at: the texts (column ``text``) that a parser refuses, and the offset it names."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                try:
                    parse(text)
                except ParseError as e:
                    rows.append((text, e.at))
            yield pd.DataFrame(rows, columns=["text", "at"])

    return texts.select("text").mapInPandas(run, "text string, at int")


def flat_families(texts: DataFrame) -> DataFrame:
    """family, name, sequence, masked of flat files (path, text): the sequences of each family, whole and cut to its mask."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(f["family"], name, s, masked(s, f["mask"])) for text in pdf["text"] for f in parse_pandit(text) for name, s in f["sequences"]]
            yield pd.DataFrame(rows, columns=["family", "name", "sequence", "masked"])

    return texts.select("text").mapInPandas(run, "family string, name string, sequence string, masked string")


def _local(path: str) -> str:
    return re.sub("^file:/+", "/", path)


class _NewickReader(DataSourceReader):
    """One partition a file, on a file system that executors mount; for other stores see read_whole() and newick_nodes()."""

    def __init__(self, options: dict):
        self.pattern = _local(options["path"])

    def partitions(self):
        import glob
        import os

        found = [self.pattern] if os.path.isfile(self.pattern) else glob.glob(os.path.join(self.pattern, "**") if os.path.isdir(self.pattern) else self.pattern, recursive=True)
        files = sorted(f for f in found if os.path.isfile(f) and os.path.basename(f)[0] not in "._")
        if not files:
            raise ValueError(f"no files: {self.pattern}")
        return [InputPartition(f) for f in files]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for row in parse_newick(f.read()):
                yield (partition.value, *row)


class NewickSource(DataSource):
    """spark.read.format("newick").load(path): the nodes of the tree in each file."""

    @classmethod
    def name(cls) -> str:
        return "newick"

    def schema(self) -> str:
        return TREE_NODES

    def reader(self, schema):
        return _NewickReader(self.options)


class FastaRangeReader(DataSourceReader):
    """Reads a FASTA file on a file system that executors mount, by byte ranges."""

    def __init__(self, options: dict):
        self.path, self.step = _local(options["path"]), int(options.get("bytes_per_partition", 128 << 20))

    def partitions(self):
        import os

        return [InputPartition(k) for k in range(max(1, -(-os.path.getsize(self.path) // self.step)))]

    def read(self, partition) -> Iterator[tuple]:
        """Records whose header begins in the range."""
        start, stop = partition.value * self.step, (partition.value + 1) * self.step
        with open(self.path, "rb") as f:
            f.seek(max(0, start - 1))
            if start:
                f.readline()
            name, at, parts = None, 0, []
            while True:
                here = f.tell()
                line = f.readline()
                if not line or line.startswith(b">"):
                    if name is not None:
                        yield (self.path, at, name, "".join(parts))
                    if not line or here >= stop:
                        return
                    words = line[1:].split()
                    if not words:
                        raise ParseError("sequence without name", here)
                    name, at, parts = words[0].decode(), here, []
                elif name is not None:
                    parts.append(_known("".join(line.decode().split()).upper(), here))
                elif line.strip() and not start:
                    raise ParseError("text before the first header", here)


class FastaSource(DataSource):
    """spark.read.format("fasta"): path, offset of the header, name, sequence."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "path string, offset long, name string, sequence string"

    def reader(self, schema):
        return FastaRangeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NewickSource)
    spark.dataSource.register(FastaSource)
