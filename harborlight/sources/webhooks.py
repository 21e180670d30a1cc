"""Webhook and provider events: signatures, flattening, stream lines."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions import payload
from harborlight.functions.base import col

# Paths under which events keep their fields.
ID_PATHS = ["$.jobId", "$.job_id", "$.id", "$.batchId", "$.data.id", "$.data.jobId"]
EVENT_PATHS = ["$.event", "$.type", "$.eventType"]
STATUS_PATHS = ["$.status", "$.data.status", "$.state"]
LINK_PATHS = ["$.metadata.sourceUrl", "$.metadata.siteUrl", "$.data.sourceUrl", "$.sourceUrl", "$.url"]


def signature_of(body: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex: two digests over the body behind the key's inner and outer padding."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda byte: F.lit(bytearray(k ^ byte for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def verified(events: DataFrame, secret: str) -> DataFrame:
    """Adds error: null for a sound event, else missing_signature, bad_signature or bad_json."""
    given = F.regexp_replace("signature", "^sha256=", "")
    error = F.when(F.coalesce(given, F.lit("")) == "", "missing_signature").when(F.lower(given) != signature_of(F.col("body"), secret), "bad_signature").when(payload.variant("body").isNull(), "bad_json")
    return events.withColumn("error", error)


def _first(v: Column, paths: list[str]) -> Column:
    return F.coalesce(*(F.nullif(payload.get(v, p), F.lit("")) for p in paths))


def flat_events(events: DataFrame) -> DataFrame:
    """One row an event, whatever spelling it uses: jobId, event, status, sourceUrl, success, error."""
    v = payload.variant("body")
    return events.select(
        "*", _first(v, ID_PATHS).alias("jobId"), F.coalesce(_first(v, EVENT_PATHS), F.lit("unknown")).alias("event"), _first(v, STATUS_PATHS).alias("status"), _first(v, LINK_PATHS).alias("sourceUrl"),
        payload.get(v, "$.success", "boolean").alias("success"), _first(v, ["$.error", "$.data.error", "$.message"]).alias("failure"),
    )


def upsert_events(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Stored events after a delivery: keyed by (jobId, event); a real event closes the job's pending row, and one that
    comes after the job was processed is stored as processed."""
    new = arrived.groupBy("jobId", "event").agg(F.min("receivedAt").alias("receivedAt")).join(stored.select("jobId", "event"), ["jobId", "event"], "left_anti")
    done = stored.where("processed").select("jobId").distinct().withColumn("done", F.lit(True))
    real = arrived.where("event <> 'pending'").groupBy("jobId").agg(F.min("event").alias("closer"))
    late = F.coalesce(F.col("done"), F.lit(False)) & (F.col("event") != "pending")
    added = new.join(done, "jobId", "left").select("jobId", "event", "receivedAt", late.alias("processed"), F.when(late, "already_processed").alias("error"))
    kept = stored.join(real, "jobId", "left")
    closes = (F.col("event") == "pending") & ~F.col("processed") & F.col("closer").isNotNull()
    return kept.select("jobId", "event", "receivedAt", (F.col("processed") | closes).alias("processed"), F.when(closes, F.col("closer")).otherwise(F.col("error")).alias("error")).unionByName(added)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a stream dump: parsed ones as JSON text, the rest as raw text."""
    t = spark.read.text(path)
    ok = payload.variant("value").isNotNull()
    return t.select(F.when(ok, F.col("value")).alias("json"), F.when(~ok, F.col("value")).alias("raw"))


def provider_rows(chunks: DataFrame, column: str = "body") -> DataFrame:
    """Rows of provider dumps, a list of lists or a wrapped response: url, status, text, cost in thousandths of a cent, ms."""
    v = payload.variant(column)
    lists = F.coalesce(payload.get(v, "$.response", "array<array<variant>>"), payload.get(v, "$", "array<array<variant>>"))
    r = F.col("r")
    cost = payload.number(r, "$.costs.total_cost")
    return chunks.withColumn("r", F.explode(F.flatten(lists))).select(
        payload.get(r, "$.url").alias("url"), payload.get(r, "$.status", "int").alias("status"), F.coalesce(payload.get(r, "$.content.commonmark"), payload.get(r, "$.content.raw")).alias("text"),
        F.round(cost * 100_000).cast("long").alias("cost_milli_cents"), payload.get(r, "$.duration_elasped_ms", "long").alias("ms"),
    )


def headers_redacted(c: Column | str) -> Column:
    return payload.redact_headers(F.from_json(col(c), "map<string,string>"))
