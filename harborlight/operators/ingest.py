"""Composite sinks of an ingest: one micro-batch of scrapes to raw rows, activity, jobs, details, ignored rows and queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import payload
from harborlight.operators import extract, merge, queue

MOST_CHARS = 8000


def trimmed(scrapes: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Raw payloads cut to the store's size, with their former length."""
    return scrapes.withColumn("n_chars", F.length("payload").cast("long")).withColumn("payload", F.substring("payload", 1, most))


def activity(scrapes: DataFrame) -> DataFrame:
    return scrapes.select("sourceUrl", "startedAt", "completedAt", payload.count_rows(payload.variant("payload")).cast("long").alias("jobCount"))


def jobs_of(rows: DataFrame, stored: DataFrame, gate: Column) -> dict[str, DataFrame]:
    """Extracted rows that insert into jobs and job details, and those that are ignored by the gate; the first row an address wins."""
    rows = rows.withColumn("_ok", F.coalesce(gate, F.lit(False)))
    fresh = merge.insert_absent(stored, rows.where("_ok"), ["url"], [F.col("startedAt"), F.col("title")]).drop("_ok")
    ignored = rows.where("not _ok").select("url", "title", F.lit("filtered").alias("reason")).dropDuplicates(["url"])
    jobs, details = merge.split_columns(fresh.withColumn("_id", F.sha2("url", 256)), "_id", ["completedAt"], "jobId")
    return {"jobs": jobs, "details": details, "ignored": ignored}


def batch_writer(path: str, read_jobs: Callable[[], DataFrame], gate: Column, now_ms: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes every sink under the batch's own folder, so that a replay overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        at = lambda name: f"{path}/{name}/batch={number}"
        extracted = extract.extract_jobs(batch, now_ms)
        extracted.write.mode("overwrite").parquet(at("extracted"))
        rows = batch.sparkSession.read.schema(extracted.schema).parquet(at("extracted"))
        sinks = {"scrapes": trimmed(batch), "activity": activity(batch), **jobs_of(rows, read_jobs(), gate)}
        for name, df in sinks.items():
            df.write.mode("overwrite").parquet(at(name))

    return write


def listing_flow(found: DataFrame, seen: DataFrame, jobs: DataFrame, ignored: DataFrame, stored: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """Addresses of a listing to the queue: minus seen and skipped ones, minus jobs, then enqueue."""
    left = found.join(seen.select("url").distinct(), "url", "left_anti")
    return queue.enqueue(left, stored, jobs, ignored, now_ms)
