"""Streams: scoring arriving sites, running pattern counts, progress with state.

Inputs are folders of Parquet that files arrive in.  ``run_available`` processes what is there and stops,
from where its checkpoint left off.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import runs
from ..operators.infer import Inference
from ..sources.store import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A stream over rows that were written as files first."""
    path = folder(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def run_available(stream: DataFrame, mode: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there into a folder and reads that back.

    With ``by``, batches hold new values of keys and the last of each key is read.
    """
    spark = stream.sparkSession
    out = folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{out}/batch=*")
    if by is None:
        return done.drop("batch_no")
    values = [c for c in done.columns if c not in (*by, "batch_no")]
    last = done.groupBy(*by).agg(F.max(F.struct("batch_no", *values)).alias("v"))
    return last.select(*by, *[F.col(f"v.{c}").alias(c) for c in values])


def scored_stream(spark: SparkSession, sites: DataFrame, inference: Inference) -> DataFrame:
    """Log-likelihoods of arriving sites; no state."""
    return run_available(inference.log_likelihoods(landed(spark, sites, "sites")), "append", "scores")


def running_patterns(spark: SparkSession, sites: DataFrame, by: list[str]) -> DataFrame:
    """Weights of distinct columns, kept up to date as sites arrive."""
    counts = landed(spark, sites, "columns").groupBy(*by).agg(F.count("*").alias("weight"))
    return run_available(counts, "update", "patterns", by)


def progress_milestones(spark: SparkSession, events: DataFrame) -> DataFrame:
    """event_id, user_id, bucket of the events that bring a user to a higher bucket, are the first, or (``last``, where there is such
    a column) the last; the state is the highest bucket.  Only a user's own events need an order, so they are dealt by user.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("event_id")
        before = rows["bucket"].cummax().shift(fill_value=last).clip(lower=last)
        out = rows[(rows["bucket"] > before) | rows["last"]]
        state.update((int(max(last, rows["bucket"].max())),))
        yield out[["event_id", "user_id", "bucket"]]

    events = events if "last" in events.columns else events.withColumn("last", F.lit(False))
    ordered = events.repartition("user_id").sortWithinPartitions("event_id")
    milestones = landed(spark, ordered, "events").groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, bucket long", "last long", "append", GroupStateTimeout.NoTimeout)
    return run_available(milestones, "append", "milestones")


_SHOWN = "file string, line_no long, kind string, line string"
#: State of this kind of operator needs this store.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Lines that need no state are dealt to so many keys.
SPREAD = 64


class _Progress(StatefulProcessor):
    """The tenth of a run that was shown last, and a timer that tells when the run has said nothing for a while."""

    def __init__(self, silent_ms: int | None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "bucket int, line_no long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("line_no")
        if lines["bucket"].isna().all():
            yield lines[["file", "line_no", "kind", "line"]]
            return
        last, keep = (self.last.get()[0] if self.last.exists() else -1), []
        for bucket, resets, kind in zip(lines["bucket"], lines["resets"], lines["kind"], strict=True):
            keep.append(bool(resets) or bucket > last or kind == "line")
            last = int(bucket) if resets or bucket > last else last
        end = lines.iloc[-1]
        self.last.update((last, int(end["line_no"]), end["line"]))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last < 10:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield lines[keep].assign(kind="progress")[["file", "line_no", "kind", "line"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, line_no, line = self.last.get()
        yield pd.DataFrame({"file": [key[0]], "line_no": [line_no], "kind": ["silent"], "line": [line]})

    def close(self) -> None:
        pass


def render_available(spark: SparkSession, arriving: str, shown: str, state: str, level: str = "compact", silent_ms: int | None = None) -> None:
    """Shows the new lines among Parquet files (file, line_no, line) in the folder ``arriving``, as runs.rendered() would all of them at once.

    Appends to ``shown`` and remembers each run's last tenth under ``state``, so that a later call, after a restart too, goes on from there.
    Files are taken one a batch, in the order they were written, and a log's lines must arrive in their order.  With ``silent_ms``, a
    run that has not reached its end and says nothing for so long is shown as ``silent``, by its last line.
    """
    before = {key: spark.conf.get(key, None) for key in ROCKS}
    try:
        for key, value in ROCKS.items():
            spark.conf.set(key, value)
        lines = spark.readStream.schema("file string, line_no long, line string").option("maxFilesPerTrigger", 1).parquet(arriving)
        rows = runs.classified(lines, level)
        rows = rows.withColumn("identity", F.coalesce("identity", F.concat(F.lit("#"), F.pmod("line_no", F.lit(SPREAD)).cast("string"))))
        out = rows.groupBy("file", "identity").transformWithStateInPandas(_Progress(silent_ms), _SHOWN, "Append", "None" if silent_ms is None else "ProcessingTime")
        out.writeStream.outputMode("append").format("parquet").option("path", shown).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
