"""Documents by block: rows that lie together in a file, named alike in every read of the same files.

Texts are kept as one compressed row a block, about a third of their size, in a table bucketed by block.
What is found out about a block elsewhere is sent to its bucket; the texts themselves are not shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trimmed

PACKED = "block long, body binary"


def filed(docs: DataFrame, store: Scratch) -> DataFrame:
    """docs, written first if it is not read from files, so that each located() of it names its rows alike."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return store.put(docs, "documents")


def located(docs: DataFrame, store: Scratch, rows: int, columns: list) -> DataFrame:
    """The columns (names or expressions), block, and rid, the row's number in the block.

    What is not read from files is written first, anew at each call: see filed().
    """
    names = [F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {rows}")).alias("block"), F.expr(f"CAST(_metadata.row_index % {rows} AS INT)").alias("rid")]
    return filed(docs, store).select(*columns, *names)


def stored(located_docs: DataFrame, columns: list[str], store: Scratch, buckets: int) -> DataFrame:
    """PACKED rows of the documents in the shared folder, bucketed by block."""
    packed = located_docs.select(*columns, "block").mapInArrow(packing(columns), PACKED)
    return store.put_by(packed, "block", buckets, "blocks", deal=False, compression="uncompressed")


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal values."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True))


def packing(columns: list[str]) -> Callable:
    """A mapInArrow function: batches with block and the columns -> PACKED rows."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        held, size, block = [], 0, None
        for batch in batches:
            for a, b in runs(batch.column("block").to_numpy()):
                here = batch.column("block")[a].as_py()
                if block is not None and (here != block or size > 4_000_000):
                    yield packed(press, block, held)
                    held, size = [], 0
                block = here
                part = batch.slice(a, b - a).select(columns)
                held.append([part.column(c).to_pylist() for c in columns])
                size += part.nbytes
        if held:
            yield packed(press, block, held)
        trimmed()

    def packed(press, block, held):
        data = pickle.dumps([[x for part in column for x in part] for column in zip(*held, strict=True)], protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([press.compress(data)], pa.binary())], names=["block", "body"])

    return run


def unpacked(rows: pa.Table):
    """The columns of each packed row, as lists."""
    press = zstandard.ZstdDecompressor()
    for body in rows.column("body"):
        yield pickle.loads(press.decompress(body.as_buffer()))
