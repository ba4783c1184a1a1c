"""Helpers shared by the operators of this package: table access, shared storage, batch views."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir

#: Holds while a table is written here.  Texts are long, so Arrow batches are short.  Where the texts of some
#: documents are picked by id, Spark may drop the others by a Bloom filter (8 MB at most) before it shuffles.
#: A job's shuffle files go when its table is written.
WRITE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}

#: A word is a maximal run of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder that cut lineage: each put() writes Parquet and reads it back.

    A lost executor then costs a re-read, not a recomputation of everything before.  drop() deletes tables that no
    returned frame reads, close() all of them; as a context, a store is closed by an error and else left as it is.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.close()

    @contextlib.contextmanager
    def settings(self):
        before = {key: self.spark.conf.get(key, None) for key in WRITE_CONF}
        try:
            for key, value in WRITE_CONF.items():
                self.spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)

    def _path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(name)
        with self.settings():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path, None
        return out

    def put_by(self, df: DataFrame, key: str, buckets: int, name: str, deal: bool = True, compression: str = "zstd", onto: DataFrame | None = None) -> DataFrame:
        """put(), bucketed by a column: what is grouped or joined by it then stays where it lies.

        Rows are dealt to their buckets first unless a task's rows belong to few of them anyhow.  They are added to the table
        ``onto``, if it is given; a frame of it from before has its old rows only.
        """
        path, own = onto._scratch if onto is not None else (self._path(name), f"{name}_{uuid.uuid4().hex}")
        with self.settings():
            df = df.repartition(buckets, key) if deal else df
            df.write.mode("error" if onto is None else "append").bucketBy(buckets, key).option("compression", compression).option("path", path).saveAsTable(own)
        if onto is None:
            self.tables.append(own)
        out = self.spark.table(own)
        out._scratch = path, own
        return out

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, own = df._scratch
            if own:
                self.spark.sql(f"DROP TABLE IF EXISTS {own}")
                self.tables.remove(own)
            self._delete(path)

    def close(self) -> None:
        for own in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {own}")
        self.tables = []
        self._delete(self.root)


#: Bytes of ids that go to every executor at most; see small().
BROADCAST_BYTES = 64 << 20


def small(ids: DataFrame, row_bytes: int = 24) -> DataFrame:
    """A written table as the side of a join: sent to every executor if its counted rows fit BROADCAST_BYTES, else shuffled."""
    return F.broadcast(ids) if ids.count() * row_bytes <= BROADCAST_BYTES else ids.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(result=None):
    """The result of a group's or a partition's work, once memory freed on the way has gone back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
    return result


def word_count(text: str | Column) -> Column:
    """Number of words; null counts as none.  JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def byte_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and row offsets into them (n + 1).  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)
