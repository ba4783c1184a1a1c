"""Tables in the folder that all executors share, with an owner that deletes them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session runs on one machine and names no shared folder.
ONE_MACHINE = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Without that setting a cluster has no folder that all executors see, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = ONE_MACHINE
    return named.rstrip("/")


class Store:
    """put() cuts lineage: a table is written and read back, so a lost executor costs a read.  close() deletes all tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def put(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._stored)

    def close(self) -> None:
        self._delete(self.root)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def kept(spark: SparkSession, name: str) -> Store:
    """A store for what a result reads only when it is collected: its tables go when the session's process ends."""
    store = Store(spark, name)
    atexit.register(_gone, store)
    return store


def _gone(store: Store) -> None:
    if store.spark._jsc is not None and not store.spark._jsc.sc().isStopped():
        store.close()
