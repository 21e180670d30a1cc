"""Streaming queries: each drains the events table as a stream and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.operators.scratch import place
from harborlight.plans.registry import Registry
from harborlight.streaming import flows

R = Registry()


@R.add("stream_first_events", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 86400000000 AS day FROM events) GROUP BY ALL")
def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of one user, type and day count once, whatever order they come in."""
    events = flows.event_stream(spark, sf_dir).withColumn("day", F.unix_date(F.to_date("ts")))
    at = place(spark, "first-events")
    kept = flows.to_files(flows.first_events(events, ["user_id", "event_type", "day"], "40 days").select("user_id", "event_type", "day"), f"{at}/out", f"{at}/state")
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@R.add("stream_upserts", "SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches as idempotent partial rows, a folder a batch; the totals merge them."""
    at = place(spark, "upserts")

    def apply(batch: DataFrame, number: int) -> None:
        last = F.max(F.struct("ts", "event_id", "event_type"))
        batch.groupBy("user_id").agg(F.count("*").alias("n"), last.alias("last")).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    flows.per_batch(flows.event_stream(spark, sf_dir), apply, f"{at}/state")
    rows = spark.read.parquet(f"{at}/rows")
    return rows.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select("user_id", "n", F.col("last.event_type").alias("last_type"))
