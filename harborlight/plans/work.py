"""Work-queue, schedule and run-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harborlight.bindings import NOW_MS, oracle, shape
from harborlight.functions import clock, payload
from harborlight.operators import queue, rollups
from harborlight.plans.registry import Registry

R = Registry()
_WEEK = 7 * clock.DAY_MS
_DUE = f"status = 'pending' AND scheduledAt <= {NOW_MS}"
_BUCKET = "coalesce(siteId, sourceUrl)"
_LEASE = f"""
freed AS (SELECT * REPLACE (CASE WHEN status = 'processing' AND coalesce(updatedAt, 0) < {NOW_MS} - 1200000 THEN 'pending' ELSE status END AS status) FROM queue),
ready AS (SELECT *, {_BUCKET} AS bucket FROM freed WHERE {_DUE}),
live AS (SELECT * FROM ready WHERE createdAt >= {NOW_MS} - {_WEEK} ORDER BY attempts, scheduledAt, createdAt, url LIMIT 300),
turns AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY attempts, scheduledAt, createdAt, url) AS turn, min((attempts, scheduledAt, createdAt, url)) OVER (PARTITION BY bucket) AS lead FROM live)"""


@R.add("queue_lease", oracle("SELECT url, 'processing' AS status, attempts + 1 AS attempts, turn FROM turns ORDER BY turn, lead LIMIT 100", "queue", ctes=_LEASE))
def queue_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.lease(shape(spark, sf_dir, "queue"), NOW_MS, 100)["leased"].select("url", "status", "attempts", F.col("turn").cast("long").alias("turn"))


@R.add("queue_lease_expired", oracle(f"SELECT url, 'failed' AS status FROM ready WHERE createdAt < {NOW_MS} - {_WEEK}", "queue", ctes=_LEASE))
def queue_lease_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.lease(shape(spark, sf_dir, "queue"), NOW_MS, 100)["expired"].select("url", "status")


@R.add("queue_release", oracle(f"SELECT url, CASE WHEN status = 'processing' AND coalesce(updatedAt, 0) < {NOW_MS} - 3600000 THEN 'pending' ELSE status END AS status FROM queue", "queue"))
def queue_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.release_expired(shape(spark, sf_dir, "queue"), NOW_MS, clock.HOUR_MS).select("url", "status")


_RESULTS = "r AS (SELECT url, CASE event_id % 3 WHEN 0 THEN 'completed' ELSE 'failed' END AS new_status, CASE WHEN event_id % 7 = 0 THEN 'HTTP 404' END AS error FROM queue WHERE status = 'processing')"


def _results(q: DataFrame) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "completed").otherwise("failed")
    return q.where("status = 'processing'").select("url", status.alias("new_status"), F.when(F.col("event_id") % 7 == 0, "HTTP 404").alias("error"))


@R.add("queue_complete", oracle(f"SELECT url, coalesce(new_status, status) AS status, CASE WHEN new_status = 'completed' THEN {NOW_MS} END AS completedAt FROM queue LEFT JOIN r USING (url) WHERE NOT coalesce(new_status = 'failed' AND (attempts >= 3 OR contains(coalesce(error, ''), '404')), false)", "queue", ctes=_RESULTS))
def queue_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = shape(spark, sf_dir, "queue")
    return queue.complete(q, _results(q), NOW_MS)["queue"].select("url", "status", "completedAt")


@R.add("queue_ignored", oracle("SELECT url, CASE WHEN contains(coalesce(error, ''), '404') THEN 'http_404' ELSE 'max_attempts' END AS reason FROM queue JOIN r USING (url) WHERE new_status = 'failed' AND (attempts >= 3 OR contains(coalesce(error, ''), '404'))", "queue", ctes=_RESULTS))
def queue_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = shape(spark, sf_dir, "queue")
    return queue.complete(q, _results(q), NOW_MS)["ignored"]


_ENQUEUE = f"""
req AS (SELECT * FROM queue), store AS (SELECT * FROM queue WHERE event_id % 3 = 0), ign AS (SELECT url FROM queue WHERE event_id % 10 = 4), job AS (SELECT url FROM queue WHERE event_id % 14 = 6),
kept AS (SELECT * FROM req WHERE url NOT IN (SELECT url FROM ign) AND url NOT IN (SELECT url FROM job)),
again AS (SELECT url FROM store WHERE status IN ('completed', 'failed', 'invalid') OR createdAt < {NOW_MS} - {_WEEK} OR coalesce(updatedAt, createdAt) < {NOW_MS} - {_WEEK})"""


@R.add("queue_enqueue", oracle("""
SELECT url, 'seen' AS kind FROM req WHERE url IN (SELECT url FROM job) AND url NOT IN (SELECT url FROM ign)
UNION ALL SELECT url, 'requeued' FROM kept WHERE url IN (SELECT url FROM again) UNION ALL SELECT url, 'inserted' FROM kept WHERE url NOT IN (SELECT url FROM store)""", "queue", ctes=_ENQUEUE))  # fmt: skip
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = shape(spark, sf_dir, "queue")
    requests = q.select("url", "sourceUrl", F.lit(0).alias("delay_ms"), F.col("event_id").alias("pos"))
    out = queue.sorted_requests(requests, q.where("event_id % 3 = 0"), q.where("event_id % 14 = 6"), q.where("event_id % 10 = 4"), NOW_MS)
    return out.where("kind <> 'kept'").select("url", "kind")


@R.add("queue_purge", oracle(f"SELECT url FROM queue WHERE NOT (status IN ('pending', 'processing') AND createdAt < {NOW_MS} - {_WEEK})", "queue"))
def queue_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.purge(shape(spark, sf_dir, "queue"), NOW_MS).select("url")


@R.add("queue_status", oracle(f"SELECT status, count(*) AS n, ({NOW_MS} - min(createdAt)) // 60000 AS oldest_min, CAST(floor(({NOW_MS} - max(createdAt)) / 60000) AS BIGINT) AS newest_min FROM queue GROUP BY status", "queue"))
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.status_counts(shape(spark, sf_dir, "queue"), "status", "createdAt", NOW_MS)


@R.add("queue_over_attempts", oracle("SELECT status, count(*) AS n, array_to_string(list_sort(list(url))[1:25], ' ') AS sample FROM queue WHERE status = 'pending' AND attempts >= 4 GROUP BY status", "queue"))
def queue_over_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over the attempt cap, with a sample of 25; the sample is ranked first so that no list grows with the table."""
    over = shape(spark, sf_dir, "queue").where("status = 'pending' and attempts >= 4")
    count = over.groupBy("status").agg(F.count("*").alias("n"))
    sample = over.select("status", "url").orderBy("url").limit(25).groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("sample"))
    return count.join(sample, "status")


@R.add("queue_stagger", oracle("SELECT url, CASE WHEN attempts = 0 THEN (row_number() OVER (PARTITION BY sourceUrl, attempts = 0 ORDER BY event_id) - 1) * 30000 ELSE 0 END AS delay_ms FROM queue", "queue"))
def queue_stagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.stagger(shape(spark, sf_dir, "queue"), F.col("attempts") == 0, [F.col("event_id")]).select("url", F.col("delay_ms").cast("long").alias("delay_ms"))


@R.add("queue_durations", oracle(f"SELECT url, greatest(coalesce(updatedAt, {NOW_MS}) - createdAt, 0) AS elapsed_ms FROM queue", "queue"))
def queue_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = clock.elapsed(F.col("createdAt"), F.lit(None).cast("long"), F.col("updatedAt"), F.lit(NOW_MS))
    return shape(spark, sf_dir, "queue").select("url", took.alias("elapsed_ms"))


@R.add("active_workers", oracle(f"SELECT workerId, max(at_ms) AS last_beat, max(at_ms) >= {NOW_MS} - 90000 AS active FROM runs WHERE at_ms <= {NOW_MS} GROUP BY workerId", "runs"))
def active_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = shape(spark, sf_dir, "runs").where(F.col("at_ms") <= NOW_MS).groupBy("workerId").agg(F.max("at_ms").alias("last_beat"))
    return beats.withColumn("active", F.col("last_beat") >= NOW_MS - 90_000)


@R.add("workers_merged", oracle("SELECT workerId, arg_max(kind, (at_ms, kind)) AS kind, max(at_ms) AS at_ms, array_to_string(list_sort(list_distinct(list(site))), ',') AS all_values FROM runs GROUP BY workerId", "runs"))
def workers_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.merged_by_latest(shape(spark, sf_dir, "runs"), "workerId", "at_ms", ["kind"], "site")


@R.add("runs_latest", oracle("SELECT workerId, arg_max(runId, (at_ms, runId)) AS latest, arg_max(runId, (at_ms, runId)) FILTER (kind = 'purchase') AS latest_done FROM runs GROUP BY workerId", "runs"))
def runs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of each key and its newest completed one, in one aggregation."""
    at = F.struct("at_ms", "runId")
    return shape(spark, sf_dir, "runs").groupBy("workerId").agg(F.max_by("runId", at).alias("latest"), F.max_by("runId", F.when(F.col("kind") == "purchase", at)).alias("latest_done"))


@R.add("runs_by_url", oracle("SELECT site, runId, n AS rank FROM (SELECT site, runId, row_number() OVER (PARTITION BY site ORDER BY at_ms DESC, runId) AS n FROM runs) WHERE n <= 5", "runs"))
def runs_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.ranked(shape(spark, sf_dir, "runs"), ["site"], [F.desc("at_ms"), F.col("runId")], 5).select("site", "runId", "rank")


@R.add("errors_by_event", oracle("SELECT site, count(*) AS n, max(at_ms) AS last_at FROM runs WHERE kind = 'error' GROUP BY site", "runs"))
def errors_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "runs").where("kind = 'error'").groupBy("site").agg(F.count("*").alias("n"), F.max("at_ms").alias("last_at"))


@R.add("webhook_idempotent", oracle("""
SELECT workerId, kind, runId, first_done < at_ms AND kind <> 'view' AS already_processed FROM (
  SELECT *, row_number() OVER (PARTITION BY workerId, kind ORDER BY at_ms, runId) AS n, min(at_ms) FILTER (kind = 'purchase') OVER (PARTITION BY workerId) AS first_done FROM runs) WHERE n = 1""", "runs"))  # fmt: skip
def webhook_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored event a (job, event); one that arrives after the job was processed is stored as processed."""
    runs = shape(spark, sf_dir, "runs")
    done = F.min(F.when(F.col("kind") == "purchase", F.col("at_ms"))).over(W.partitionBy("workerId"))
    n = F.row_number().over(W.partitionBy("workerId", "kind").orderBy("at_ms", "runId"))
    first = runs.withColumn("done", done).withColumn("n", n).where("n = 1")
    return first.select("workerId", "kind", "runId", ((F.col("done") < F.col("at_ms")) & (F.col("kind") != "view")).alias("already_processed"))


@R.add("payload_numbers", oracle("SELECT event_id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, CAST(json_extract_string(payload, '$.k') AS DOUBLE) AS top FROM runs", "runs"))
def payload_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = payload.variant("payload")
    return shape(spark, sf_dir, "runs").select("event_id", payload.get(v, "$.k", "long").alias("k"), payload.max_number_under("payload", "k").alias("top"))


@R.add("cost_split", oracle("SELECT site, sum(milli) AS total, CAST(floor(sum(milli) / greatest(count(*), 1)) AS BIGINT) AS each FROM (SELECT site, CAST(floor(cost * 100000 + 0.5) AS BIGINT) AS milli FROM runs) GROUP BY site", "runs"))
def cost_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harborlight.functions import pay

    g = shape(spark, sf_dir, "runs").groupBy("site").agg(F.sum(pay.cost_milli_cents(F.col("cost"))).alias("total"), F.count("*").alias("n"))
    return g.select("site", "total", pay.even_cost(F.col("total"), F.col("n")).alias("each"))


_SLOT = """
SELECT event_id, CASE WHEN isodow(l) <= 5 AND hour(l) * 60 + minute(l) >= 510 THEN epoch_ms(timezone('America/Denver', date_trunc('day', l))) + (510 + ((hour(l) * 60 + minute(l) - 510) // 90) * 90) * 60000 END AS slot_ms
FROM (SELECT event_id, timezone('America/Denver', timezone('UTC', ts)) AS l FROM events)"""


@R.add("schedule_slots", _SLOT)
def schedule_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.array(*map(F.lit, clock.DAYS[:5]))
    runs = shape(spark, sf_dir, "runs")
    return runs.select("event_id", clock.latest_slot(F.col("at_ms"), days, F.lit("08:30"), F.lit(90), "America/Denver").alias("slot_ms"))


@R.add("site_verdicts", oracle(f"""
SELECT site, CASE WHEN errors > 130 THEN 'failed' WHEN last_at > {NOW_MS} + 950000000 THEN 'locked' WHEN done % 5 = 0 THEN 'completed' WHEN last_at < {NOW_MS} THEN 'due' ELSE 'skip' END AS verdict FROM (
  SELECT site, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'purchase') AS done, max(at_ms) AS last_at FROM runs GROUP BY site)""", "runs"))  # fmt: skip
def site_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's cascade over per-site facts: the first verdict that holds."""
    g = shape(spark, sf_dir, "runs").groupBy("site").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "purchase").alias("done"), F.max("at_ms").alias("last_at"))
    verdict = F.when(F.col("errors") > 130, "failed").when(F.col("last_at") > NOW_MS + 950_000_000, "locked").when(F.col("done") % 5 == 0, "completed").when(F.col("last_at") < NOW_MS, "due").otherwise("skip")
    return g.select("site", verdict.alias("verdict"))


@R.add("lease_site", oracle("SELECT site, min(at_ms) AS slot FROM runs GROUP BY site ORDER BY slot, site LIMIT 1", "runs"))
def lease_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "runs").groupBy("site").agg(F.min("at_ms").alias("slot")).orderBy("slot", "site").limit(1)


@R.add("site_activity", oracle("SELECT site, greatest(max(at_ms) FILTER (kind = 'purchase'), max(at_ms) FILTER (kind = 'error'), max(at_ms) FILTER (kind = 'view')) AS last_activity, count(*) AS n_runs FROM runs GROUP BY site", "runs"))
def site_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("at_ms")))
    return shape(spark, sf_dir, "runs").groupBy("site").agg(F.greatest(last("purchase"), last("error"), last("view")).alias("last_activity"), F.count("*").alias("n_runs"))


@R.add("sites_deduped", oracle("SELECT runId, site, n = 1 AS enabled, CASE WHEN n > 1 THEN 'duplicate_of:' || head END AS note FROM (SELECT runId, site, row_number() OVER w AS n, first_value(runId) OVER w AS head FROM runs WINDOW w AS (PARTITION BY site, workerId ORDER BY kind <> 'error' DESC, at_ms DESC, runId))", "runs"))
def sites_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks duplicates, keeps the first, marks the rest with the one they repeat."""
    w = W.partitionBy("site", "workerId").orderBy(F.desc(F.col("kind") != "error"), F.desc("at_ms"), "runId")
    r = shape(spark, sf_dir, "runs").withColumn("n", F.row_number().over(w)).withColumn("head", F.first("runId").over(w))
    return r.select("runId", "site", (F.col("n") == 1).alias("enabled"), F.when(F.col("n") > 1, F.concat(F.lit("duplicate_of:"), F.col("head"))).alias("note"))
