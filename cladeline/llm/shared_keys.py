"""Which 64-bit keys occur in at least two documents, found in one packed shuffle.

A task gathers keys of its documents up to BATCH_KEYS at a time and compares them among themselves
first.  A key that two of them share is settled on the spot: its documents are known, and one copy of
the key goes out to tell the others.  So a key that a third of all documents hold travels once a batch
and not once a document.  Keys held once go, packed, to the shard of their leading bits, where they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_KEYS = 250_000
SHARD_KEYS = 250_000

#: The bits of a key that are compared.
KEPT = np.uint64(0xFFFF_FFFF_FFFF_0000)

#: What a packed row holds.
OPEN, TOLD, SETTLED, NOTES = 0, 1, 2, 3

PACKED = "shard int, kind int, keys binary, docs binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])


def planes(values: np.ndarray) -> bytes:
    """Little-endian values byte plane by byte plane, so that small numbers compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def steps(keys: np.ndarray) -> bytes:
    """Rising keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


class Packer:
    """Turns batches of (key, document) into packed rows.

    Keys are cut to their leading 48 bits, so now and then two keys pass for one and a document is reported that shares
    nothing; none that shares a key is missed.
    """

    def __init__(self, shards: int):
        self.shards = shards
        self.keys: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.held = 0
        self.turn = 0

    def add(self, keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.docs.append(docs)
        self.held += len(keys)
        if self.held >= BATCH_KEYS:
            yield from self.flush()

    def note(self, data: bytes, more: bytes = b"") -> pa.RecordBatch:
        """A row that passes through the shuffle as it is."""
        self.turn += 1
        return self._rows([(self.turn * 40_503 % self.shards, NOTES, data, more)])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, docs = np.concatenate(self.keys) & KEPT, np.concatenate(self.docs)
        self.keys, self.docs, self.held = [], [], 0
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        several = (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first))[run]
        rows = []
        single = ~several & new  # a document met twice under one id counts once
        for kind, pick in ((OPEN, single), (TOLD, several & new)):
            k, d = keys[pick], docs[pick]
            shard = _shard(k, self.shards)
            cuts = np.searchsorted(shard, np.arange(self.shards + 1))
            for s in np.unique(shard):
                a, b = cuts[s], cuts[s + 1]
                rows.append((int(s), kind, steps(k[a:b]), planes(d[a:b]) if kind == OPEN else b""))
        if several.any():
            k, d = keys[several], docs[several]
            for a in range(0, len(k), 65_536):
                self.turn += 1
                rows.append((self.turn * 40_503 % self.shards, SETTLED, steps(k[a : a + 65_536]), planes(d[a : a + 65_536])))
        yield self._rows(rows)

    @staticmethod
    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Rising with the key, even over the shards."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def meet(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Keys and documents of one shard's rows: those whose key at least two documents hold, and the notes."""
    kind = table.column("kind").to_numpy()
    keys, docs = table.column("keys"), table.column("docs")
    take = lambda k: np.flatnonzero(kind == k)
    view = lambda column, at: [unsteps(column[int(i)].as_buffer()) for i in at]
    out_k, out_d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    rows = take(OPEN)
    if len(rows):
        k = np.concatenate(view(keys, rows))
        d = np.concatenate([unplanes(docs[int(i)].as_buffer(), np.int64) for i in rows])
        told = take(TOLD)
        order = np.argsort(k)
        k, d = k[order], d[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(k)]))
        several = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first))[run]
        if len(told):
            t = np.unique(np.concatenate(view(keys, told)))
            at = np.minimum(np.searchsorted(t, k), len(t) - 1)
            several |= t[at] == k
        out_k.append(k[several])
        out_d.append(d[several])
    for i in take(SETTLED):
        out_k.append(unsteps(keys[int(i)].as_buffer()))
        out_d.append(unplanes(docs[int(i)].as_buffer(), np.int64))
    notes = [(keys[int(i)].as_py(), docs[int(i)].as_py()) for i in take(NOTES)]
    return np.concatenate(out_k), np.concatenate(out_d), notes


def shards_for(keys: int, least: int) -> int:
    return max(least, keys // SHARD_KEYS + 1)


def shared(docs: DataFrame, emit: Callable[[int], Callable], finish: Callable, schema: str, shards: int) -> DataFrame:
    """docs -> packed rows by emit(shards) -> one finish(table) a shard, with the given schema."""
    packed = docs.mapInArrow(emit(shards), PACKED)
    return packed.groupBy("shard").applyInArrow(finish, schema)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and UTF-8 bytes of all texts."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(f"`{text}`")))).first()
    return int(n), int(size or 0)
