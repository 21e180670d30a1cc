"""Queries over provider dumps read by the data source, validated intake with dead letters, timers and audits of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.operators.scratch import place
from harborlight.plans.registry import Registry
from harborlight.sources import dumps, intake
from harborlight.streaming import flows, timers

R = Registry()


def dumped(events: DataFrame, name: str) -> str:
    """The events as dumps, a folder for each type and day; returns the folder."""
    at = place(events.sparkSession, name)
    body = F.to_json(F.struct("event_id", "user_id", "value", F.struct(F.col("props").alias("raw")).alias("content")))
    events.select(F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("day"), body.alias("body")).write.partitionBy("provider", "day").text(at)
    return at


@R.add("dump_costs", "SELECT event_type AS provider, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids, sum(CAST(props ->> '$.k' AS BIGINT))::BIGINT AS k FROM events WHERE event_type IN ('click', 'purchase') AND strftime(ts, '%Y-%m-%d') >= '2024-01-05' GROUP BY ALL")
def dump_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps of two providers from a day on; the filters are answered from the folders' names where the session lets a source do so."""
    at = dumped(spark.read.parquet(f"{sf_dir}/events.parquet"), "dumps")
    v = F.try_parse_json("body")
    rows = dumps.read_dumps(spark, at).where(F.col("provider").isin("click", "purchase") & (F.col("day") >= "2024-01-05"))
    k = F.try_variant_get(F.try_parse_json(F.try_variant_get(v, "$.content.raw", "string")), "$.k", "long")
    return rows.groupBy("provider", "day").agg(F.count("*").alias("n"), F.sum(F.try_variant_get(v, "$.event_id", "long")).alias("ids"), F.sum(k).alias("k"))


@R.add("stream_dumps", "SELECT event_type AS provider, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def stream_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dumps as a stream into files."""
    at = dumped(spark.read.parquet(f"{sf_dir}/events.parquet"), "dumps")
    rows = dumps.stream_dumps(spark, at).select("provider", F.try_variant_get(F.try_parse_json("body"), "$.user_id", "long").alias("user_id"))
    state = place(spark, "dump-stream")
    return flows.to_files(rows, f"{state}/out", f"{state}/state").groupBy("provider").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


#: Bodies as posted, by event_id % 7: sound ones, and those that lack a field, hold another type or level, or aren't JSON.
_POSTED = """CASE event_id % 7 WHEN 0 THEN '{"title": "T' || event_id || '"' WHEN 1 THEN '[1]' WHEN 2 THEN '{"title": "T", "company": null, "description": "d", "location": "x", "remote": true, "level": "mid", "totalCompensation": 1, "url": "u"}'
  ELSE '{"title": "T' || event_id || '", "company": "' || event_type || '", "description": "d", "location": "x", "remote": ' || CASE WHEN event_id % 5 = 0 THEN '"maybe"' ELSE 'false' END || ', "level": "' || CASE user_id % 6 WHEN 0 THEN 'senior' WHEN 1 THEN 'boss' WHEN 2 THEN 'mid' ELSE 'staff' END
    || '", "totalCompensation": ' || user_id || CASE WHEN event_id % 11 = 0 THEN '' ELSE ', "url": "https://e.example.com/' || event_id || '"' END || '}' END"""


@R.add("jobs_posted", f"""
SELECT fate, reason, count(*) AS n, sum(event_id)::BIGINT AS ids, sum(pay)::BIGINT AS pay FROM (
  SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS fate, CASE WHEN reason IS NULL THEN CAST(body ->> '$.totalCompensation' AS DOUBLE) END AS pay FROM (
    SELECT event_id, body, CASE WHEN NOT json_valid(body) THEN 'bad_json' WHEN json_type(body) <> 'OBJECT' OR json_type(body, '$.remote') NOT IN ('BOOLEAN', 'NULL') THEN 'bad_json' WHEN json_type(body, '$.company') = 'NULL' THEN 'missing:company'
      WHEN json_type(body, '$.url') IS NULL THEN 'missing:url' WHEN body ->> '$.level' NOT IN ('junior', 'mid', 'senior', 'staff') THEN 'invalid:level' END AS reason
    FROM (SELECT event_id, {_POSTED} AS body FROM events))) GROUP BY fate, reason""")  # fmt: skip
def jobs_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted jobs through a stream into the accepted ones and the dead letters, by reason; the last batch is delivered twice."""
    at = place(spark, "posted")
    write = intake.writer(f"{at}/sinks", intake.FORMS["job"])

    def twice(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)

    flows.per_batch(flows.event_stream(spark, sf_dir).select("event_id", F.expr(_POSTED).alias("body")), twice, f"{at}/state")
    rows = spark.read.parquet(f"{at}/sinks")
    good = intake.written(rows, "accepted").select("event_id", F.lit("accepted").alias("fate"), F.lit(None).cast("string").alias("reason"), F.col("totalCompensation").alias("pay"))
    bad = intake.written(rows, "rejected").select("event_id", F.lit("rejected").alias("fate"), "reason", F.lit(None).cast("double").alias("pay"))
    return good.union(bad).groupBy("fate", "reason").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum("pay").cast("long").alias("pay"))


@R.add("workers_reported", "SELECT 'w' || user_id AS worker, count(*) AS beats, arg_max(event_type, (epoch_us(ts), event_id)) AS queue FROM events WHERE event_type <> 'error' GROUP BY user_id")
def workers_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats, those without a queue turned away; the last of each worker and the number of its sound ones."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    flows_of = F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("scrape").alias("type"), F.lit("RUNNING").alias("status")))
    queue = F.when(F.col("event_type") != "error", F.col("event_type"))
    body = F.to_json(F.struct(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("workerId"), F.lit("h").alias("hostname"), F.lit("a:1").alias("temporalAddress"), F.lit("default").alias("temporalNamespace"), queue.alias("taskQueue"), flows_of.alias("workflows")))
    good = intake.parted(e.select(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("at"), body.alias("body")), intake.FORMS["heartbeat"])["accepted"]
    n = good.groupBy("workerId").agg(F.count("*").alias("beats"))
    return intake.latest_workers(good, "at").join(n, "workerId").select(F.col("workerId").alias("worker"), "beats", F.col("taskQueue").alias("queue"))


_WAIT_MS = 6 * 3_600_000


@R.add("stream_recoveries", f"""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type FROM events), f AS (SELECT user_id, min(ms) AS start, min(ms) FILTER (event_type = 'purchase') AS close FROM e GROUP BY user_id),
o AS (SELECT user_id, CASE WHEN close <= start + {_WAIT_MS} THEN 'closed' ELSE 'expired' END AS outcome, CASE WHEN close <= start + {_WAIT_MS} THEN close ELSE start + {_WAIT_MS} END AS at_ms FROM f)
SELECT o.user_id, outcome, at_ms, count(*) AS events FROM o JOIN e ON e.user_id = o.user_id AND e.ms <= at_ms
WHERE outcome = 'closed' OR at_ms <= (SELECT max(ms) - 3600000 FROM e) GROUP BY ALL""")  # fmt: skip
def stream_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event starts a wait of six hours for a purchase; timers close those that wait in vain."""
    at = place(spark, "recoveries")
    with timers.keyed_state(spark):
        out = flows.to_files(timers.recoveries(flows.event_stream(spark, sf_dir), "user_id", "purchase", _WAIT_MS, "1 hour"), f"{at}/out", f"{at}/state")
    return out.select(F.col("key").alias("user_id"), "outcome", F.col("at").alias("at_ms"), "events")


@R.add("stream_audit", """
SELECT decision, slot, count(*) AS n FROM (SELECT CASE WHEN c_custkey IS NULL THEN 'unscheduled' WHEN c_acctbal < 0 THEN 'off' WHEN m < start THEN 'waiting' ELSE 'due' END AS decision, CASE WHEN c_acctbal >= 0 AND m >= start THEN (m - start) // every END::BIGINT AS slot
FROM (SELECT user_id, (epoch_us(ts) // 60000000) % 1440 AS m FROM events) e LEFT JOIN (SELECT c_custkey, c_acctbal, c_custkey * 37 % 1200 AS start, 30 + c_nationkey * 10 AS every FROM customer WHERE c_custkey % 10 <> 0) c ON user_id = c_custkey) GROUP BY ALL""")  # fmt: skip
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a stream against static schedules."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 <> 0")
    schedules = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 37 % 1200).alias("start_min"), (F.col("c_nationkey") * 10 + 30).alias("interval_min"), (F.col("c_acctbal") >= 0).alias("enabled"))
    ticks = flows.event_stream(spark, sf_dir).select("user_id", "ts")
    at = place(spark, "audit")
    rows = flows.to_files(timers.schedule_audit(ticks, schedules, "user_id"), f"{at}/out", f"{at}/state")
    return rows.groupBy("decision", "slot").agg(F.count("*").alias("n"))
