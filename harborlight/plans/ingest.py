"""Ingest queries: payload extraction, gates, hints, provider events, over payloads built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import NOW_MS, oracle, shape
from harborlight.functions import payload, url
from harborlight.operators import extract, ingest
from harborlight.plans.registry import Registry
from harborlight.sources import webhooks

R = Registry()
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_CLEAN = f"trim(regexp_replace(replace(replace(replace(replace({_TITLE}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '\\s+', ' ', 'g'))"
_HEAD = "lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1))"
_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
_LINK = f"{_HEAD} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as scrape payloads, spelt one of two ways; every fifth has its pay as a range."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    plain = F.to_json(F.struct(F.array(F.struct(title.alias("title"), F.col("url").alias("url"), F.lit("Austin, TX").alias("location"), (F.col("page_id") * 1000).cast("string").alias("compensation"))).alias("items")))
    other = F.to_json(F.struct(F.array(F.struct(title.alias("job_title"), F.col("url").alias("absolute_url"), F.struct(F.lit("Remote").alias("name")).alias("location"), F.struct(F.lit(1).alias("min"), (F.col("page_id") * 10).alias("max")).alias("salary"))).alias("normalized")))
    return p.select("page_id", F.col("url").alias("sourceUrl"), F.lit(NOW_MS).alias("startedAt"), F.lit(NOW_MS).alias("completedAt"), F.when(F.col("page_id") % 5 == 0, other).otherwise(plain).alias("payload"))


@R.add("extract_jobs", f"""
SELECT page_id, CASE WHEN length(t) > 140 THEN rtrim(substr(t, 1, 137)) || '...' ELSE t END AS title, {_LINK} AS url, CASE WHEN page_id % 5 = 0 THEN 'Remote' ELSE 'Austin, TX' END AS location, page_id % 5 = 0 OR contains(lower(t), 'remote') AS remote,
  CASE WHEN page_id = 0 THEN 1.0 WHEN page_id % 5 = 0 THEN page_id * 10.0 ELSE page_id * 1000.0 END AS pay, {NOW_MS} AS posted
FROM (SELECT page_id, url, {_CLEAN} AS t FROM pages) WHERE NOT (t = '' OR (len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) >= 8 AND (contains(lower(t), 'posted') OR contains(lower(t), 'apply'))))""")  # fmt: skip
def extract_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.extract_jobs(scrapes(spark, sf_dir), NOW_MS)
    return rows.select("page_id", "title", "url", "location", "remote", F.col("totalCompensation").alias("pay"), F.col("postedAt").alias("posted"))


@R.add("ingest_activity", f"SELECT url AS \"sourceUrl\", {NOW_MS} AS completed, 1::BIGINT AS n_jobs FROM pages")
def ingest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.activity(scrapes(spark, sf_dir)).select("sourceUrl", F.col("completedAt").alias("completed"), F.col("jobCount").alias("n_jobs"))


@R.add("ingest_new_jobs", f"""
SELECT link AS url, count(*) AS one FROM (SELECT DISTINCT {_LINK} AS link FROM pages WHERE {_CLEAN} <> '' AND contains(lower({_CLEAN}), 'tion')) WHERE link NOT IN (SELECT {_LINK} FROM pages WHERE page_id % 6 = 0) GROUP BY link""")  # fmt: skip
def ingest_new_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, then insert-if-absent: one row an address that is not stored; every sixth page is."""
    stored = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 6 = 0").select(url.job_url("url").alias("url"))
    rows = extract.extract_jobs(scrapes(spark, sf_dir), NOW_MS)
    jobs = ingest.jobs_of(rows, stored, F.lower("title").contains("tion"))["jobs"]
    return jobs.groupBy("url").agg(F.count("*").alias("one"))


@R.add("hint_places", oracle("SELECT _id, CASE WHEN location = 'Austin, TX' THEN 'Austin' END AS city, CASE WHEN location = 'Austin, TX' THEN 'Texas' END AS state FROM jobs", "jobs"))
def hint_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harborlight.functions import location

    at = location.city_state_in("location")
    return shape(spark, sf_dir, "jobs").select("_id", at["city"].alias("city"), at["state"].alias("state"))


@R.add("hint_titles", oracle("SELECT _id, CASE WHEN title = 'n/a' THEN 'n/a' ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS title, CASE title WHEN 'Staff Software Engineer' THEN 'staff' WHEN 'Senior Data Engineer - Remote' THEN 'senior' WHEN 'Junior Web Developer' THEN 'junior' WHEN 'n/a' THEN NULL ELSE 'manager' END AS level FROM jobs", "jobs"))
def hint_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\nAbout us, at length.\n"))
    h = extract.hints(body)
    return shape(spark, sf_dir, "jobs").select("_id", h["title"].alias("title"), h["level"].alias("level"))


@R.add("events_flat", "SELECT event_id, 'u' || user_id AS job, event_type AS event, CAST(value AS DOUBLE) AS cost FROM events")
def events_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook bodies in one of two spellings, flattened."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    job = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    a = F.to_json(F.struct(job.alias("jobId"), F.col("event_type").alias("event"), F.col("value").alias("cost")))
    b = F.to_json(F.struct(F.struct(job.alias("id")).alias("data"), F.col("event_type").alias("type"), F.col("value").alias("cost")))
    flat = webhooks.flat_events(e.select("event_id", F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("body")))
    return flat.select("event_id", F.col("jobId").alias("job"), "event", payload.number(payload.variant("body"), "$.cost").alias("cost"))


@R.add("events_upserted", """
SELECT job, event, CASE WHEN job IN (SELECT 'u' || user_id FROM events WHERE event_id % 2 = 0 AND event_type = 'purchase') THEN true ELSE false END AS processed FROM (SELECT DISTINCT 'u' || user_id AS job, event_type AS event FROM events)
WHERE (job, event) NOT IN (SELECT 'u' || user_id, event_type FROM events WHERE event_id % 2 = 0)""")  # fmt: skip
def events_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events of a job that was processed arrive as processed; only the added rows are returned."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("jobId"), F.col("event_type").alias("event"), F.lit(NOW_MS).alias("receivedAt"))
    stored = e.where("event_id % 2 = 0").groupBy("jobId", "event").agg(F.max("receivedAt").alias("receivedAt")).select("*", (F.col("event") == "purchase").alias("processed"), F.lit(None).cast("string").alias("error"))
    out = webhooks.upsert_events(stored, e.where("event_id % 2 = 1"))
    return out.join(stored.select("jobId", "event"), ["jobId", "event"], "left_anti").select(F.col("jobId").alias("job"), "event", "processed")


@R.add("page_job_links", """
SELECT page_id, len(list_filter(list_distinct(list_transform(regexp_extract_all(html, '(https?://[^\\s"''<>\\\\)\\]]+)', 1), lambda u: regexp_replace(u, '[.,;]+$', ''))), lambda u: regexp_matches(lower(u), 'job|career|position|opening|requisition|greenhouse|ashby|workday'))) AS n FROM pages""")  # fmt: skip
def page_job_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(payload.job_links("html")).cast("long").alias("n"))


@R.add("listing_flow", """
SELECT url, 'inserted' AS kind FROM (SELECT DISTINCT trim(url) AS url FROM pages) u WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 0) AND url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 1)""")  # fmt: skip
def listing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found addresses minus the seen and the ignored ones, to the queue."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = p.select("url", F.lit("list").alias("sourceUrl"), F.lit(0).alias("delay_ms"), F.col("page_id").alias("pos"))
    stored = spark.createDataFrame([], "url string, status string, createdAt long, updatedAt long")
    out = ingest.listing_flow(found, p.where("page_id % 7 = 0").select("url"), p.limit(0).select("url"), p.where("page_id % 7 = 1").select("url"), stored, NOW_MS)
    return out["inserted"].select("url", F.lit("inserted").alias("kind"))


@R.add("conversation_forms", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'email') OR contains(lower(text), 'e-mail') THEN 'email' WHEN regexp_matches(lower(text), 'phone|mobile') THEN 'phone' END AS key FROM conversations WHERE role <> 'system'")
def conversation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to form fields, in the turns of users and assistants."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'system'")
    key = extract.form_key("text")
    return c.select("conv_id", "turn", F.when(key.isin("email", "phone"), key).alias("key"))


@R.add("conversation_labels", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'email') OR contains(lower(text), 'e-mail') THEN 'email' WHEN regexp_matches(lower(text), 'phone|mobile') THEN 'phone' END AS key FROM conversations")
def conversation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to form fields, every turn of every conversation."""
    key = extract.form_key("text")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.when(key.isin("email", "phone"), key).alias("key"))
