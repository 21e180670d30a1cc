"""Structured Streaming wrappers: the same transitions over unbounded input, with data time as the only clock."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def first_events(events: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """One event a key within the watermark: repeats of a delivery go."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, keys: list[str], lateness: str, length: str) -> DataFrame:
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", length).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.unix_millis("w.start").alias("start_ms"), *keys, "n")


def recover_late(events: DataFrame, key: str, closing: str, wait_ms: int) -> DataFrame:
    """A timer a key: (key, outcome, at) when its closing event comes, or when the watermark passes the wait after its first event."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, closed = state.get
            state.remove()
            if not closed:
                yield pd.DataFrame({key: [k[0]], "outcome": ["expired"], "at": [first + wait_ms]})
            return
        first, closed = state.get if state.exists else (None, 0)
        closings = []
        for b in batches:  # a key's rows of one micro-batch come in several frames, in any order
            at = (b["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).to_numpy()
            first = int(at.min()) if first is None else min(first, int(at.min()))
            done = at[(b["event_type"] == closing).to_numpy()]
            closings += [int(done.min())] if len(done) else []
        if closings and not closed:
            closed = 1
            yield pd.DataFrame({key: [k[0]], "outcome": ["closed"], "at": [min(closings)]})
        state.update((first, closed))
        state.setTimeoutTimestamp(max(first + wait_ms, state.getCurrentWatermarkMs() + 1))

    out = f"{key} {events.schema[key].dataType.simpleString()}, outcome string, at long"
    return events.withWatermark("ts", "1 hour").groupBy(key).applyInPandasWithState(step, out, "first long, closed int", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drains what is there into a memory table, for tests and small checks."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains a stream into a file sink, exactly once over restarts with the same checkpoint."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def per_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a batch transition on each micro-batch; the batch number makes it idempotent for the caller."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
