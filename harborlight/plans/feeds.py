"""Feeds: signed deliveries, provider dumps, headers, configuration and import rows, timed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions import payload
from harborlight.operators import filters, ingest
from harborlight.plans.live import place
from harborlight.plans.registry import Registry
from harborlight.sources import config, webhooks
from harborlight.streaming import flows

R = Registry()
SECRET = "a shared secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(byte: int) -> str:
    """The key's block of an HMAC as a blob of DuckDB."""
    return f"from_hex('{bytes(b ^ byte for b in SECRET.encode().ljust(64, bytes(1))).hex()}')"


_SIGN = f"sha256({_pad(0x5C)} || from_hex(sha256({_pad(0x36)} || encode(props))))"


@R.add("event_signatures", f"""
SELECT event_id, {_SIGN} AS signature, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'missing_signature' WHEN event_id % 4 = 2 THEN 'bad_signature' ELSE NULL END AS error FROM events""")  # fmt: skip
def event_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed, unsigned and wrongly signed deliveries."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body"))
    signed = e.withColumn("given", webhooks.signature_of(F.col("body"), SECRET))
    turn = F.col("event_id") % 4
    sent = signed.withColumn("signature", F.when(turn == 0, F.concat(F.lit("sha256="), F.upper("given"))).when(turn == 1, "").when(turn == 2, F.reverse("given")).otherwise(F.col("given")))
    return webhooks.verified(sent, SECRET).select("event_id", F.col("given").alias("signature"), "error")


@R.add("provider_pages", """
SELECT url, 200 AS status, html AS text, CAST(round(length(html) / 1e6 * 100000) AS BIGINT) AS cost_milli_cents, CAST(length(url) AS BIGINT) AS ms FROM pages""")  # fmt: skip
def provider_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of provider dumps in both wrappings and both kinds of content."""
    row = lambda kind: F.struct("url", F.lit(200).alias("status"), F.struct(F.col("html").alias(kind)).alias("content"), F.struct((F.length("html") / 1e6).alias("total_cost")).alias("costs"), F.length("url").alias("duration_elasped_ms"))
    bare, wrapped = F.to_json(F.array(F.array(row("raw")))), F.to_json(F.struct(F.array(F.array(row("commonmark"))).alias("response")))
    dumps = _table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, bare).otherwise(wrapped).alias("body"))
    return webhooks.provider_rows(dumps)


@R.add("event_lines", "SELECT count(*) FILTER (event_id % 3 > 0) AS parsed, count(*) FILTER (event_id % 3 = 0) AS raw, CAST(sum(event_id) FILTER (event_id % 3 > 0) AS BIGINT) AS ids FROM events")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a stream dump, one in three of them broken, written and read back."""
    at = place(spark, "event-lines")
    line = F.to_json(F.struct("event_id", "event_type"))
    cut = F.concat(F.lit("data "), line)
    _table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, cut).otherwise(line).alias("value")).write.text(at)
    lines = webhooks.json_lines(spark, at)
    return lines.agg(F.count("json").alias("parsed"), F.count("raw").alias("raw"), F.sum(payload.get(payload.variant("json"), "$.event_id", "long")).alias("ids"))


@R.add("event_headers", "SELECT event_id, '***' AS cookie, '***' AS secret, event_type AS accept, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events")
def event_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with their secrets hidden, and maps without their empty entries."""
    e = _table(spark, sf_dir, "events").withColumn("h", F.to_json(F.create_map(F.lit("Set-Cookie"), F.col("user_id").cast("string"), F.lit("X-Api-Key"), F.lit("k"), F.lit("Accept"), F.col("event_type"))))
    kept = payload.drop_nulls(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.when(F.col("event_id") % 2 == 1, F.col("props"))))
    h = webhooks.headers_redacted("h")
    return e.select("event_id", h["Set-Cookie"].alias("cookie"), h["X-Api-Key"].alias("secret"), h["Accept"].alias("accept"), F.size(kept).alias("n"))


@R.add("import_lines", """
SELECT url, CASE WHEN page_id % 3 = 0 THEN url || '/*' END AS pattern, CASE WHEN page_id % 2 = 0 THEN 'workday' ELSE 'general' END AS type, CASE WHEN page_id % 5 = 0 THEN 'firecrawl' END AS provider FROM pages""")  # fmt: skip
def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an import of sites, their parts in any order."""
    part = lambda n, c: F.when(F.col("page_id") % n == 0, c)
    line = F.concat_ws(" , ", "url", part(5, F.lit("Firecrawl")), part(3, F.concat("url", F.lit("/*"))), part(2, F.lit("Workday")))
    return config.bulk_sites(_table(spark, sf_dir, "pages").select(line.alias("value")))


@R.add("schedules_fanned", """
SELECT CASE WHEN n = 1 THEN 's' || s_suppkey ELSE 's' || s_suppkey || '-' || n END AS id, CASE WHEN s_nationkey % 4 = 0 THEN 'no day' WHEN s_suppkey % 30 > 23 THEN 'start time' WHEN s_acctbal < 0 THEN 'interval' END AS problem
FROM (SELECT *, unnest(range(1, greatest(s_nationkey % 4, 1) + 1)) AS n FROM supplier)""")  # fmt: skip
def schedules_fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules with a count, one row each, and why one is refused."""
    s = _table(spark, sf_dir, "supplier")
    rows = config.fan_out(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("count"), "s_nationkey", "s_suppkey", "s_acctbal"))
    days = F.when(F.col("s_nationkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("mon"), F.lit("mon")))
    start = F.concat(F.lpad((F.col("s_suppkey") % 30).cast("string"), 2, "0"), F.lit(":00"))
    return rows.select("id", config.schedule_problems(days, start, F.when(F.col("s_acctbal") < 0, 0).otherwise(15)).alias("problem"))


@R.add("cities_merged", """
SELECT c_mktsegment AS city, n_name AS country, max(CAST(c_custkey AS BIGINT)) AS population, string_agg(DISTINCT 'a' || c_custkey % 7, ' ' ORDER BY 'a' || c_custkey % 7) AS aliases, bool_or(c_acctbal < 0) AS remote_only
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")  # fmt: skip
def cities_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities and countries written as the tables of a gazetteer, read back and merged."""
    at = place(spark, "gazetteer")
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    blank = F.lit("-")
    c.select("c_custkey", F.col("c_mktsegment").alias("name"), *[blank.alias(f"x{i}") for i in range(2, 8)], F.col("c_nationkey").alias("code"), blank.alias("x9"), (F.col("c_acctbal") < 0).cast("string").alias("admin"),
             *[blank.alias(f"x{i}") for i in range(11, 14)], F.col("c_custkey").alias("population")).write.csv(f"{at}/cities", sep="\t")
    n.select(F.col("n_nationkey").alias("code"), *[blank.alias(f"x{i}") for i in range(1, 4)], "n_name").write.csv(f"{at}/countries", sep="\t")
    cities, lands = config.geo_cities(spark, f"{at}/cities"), config.geo_countries(spark, f"{at}/countries")
    rows = cities.join(lands, "country_code").select("city", F.lit("Unknown").alias("state"), "country", "population", F.array(F.concat(F.lit("a"), F.col("population") % 7)).alias("aliases"), (F.col("admin1") == "true").alias("remoteOnly"))
    return config.merge_cities(rows).select("city", "country", "population", F.array_join("aliases", " ").alias("aliases"), F.col("remoteOnly").alias("remote_only"))


@R.add("stream_windows", """
SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) // 1000 AS start_ms, count(*) AS n FROM events
WHERE time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS <= (SELECT to_timestamp(epoch_us(max(ts)) // 1000 / 1000) AT TIME ZONE 'UTC' - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")  # fmt: skip
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each type in windows of six hours, given out as the watermark closes them."""
    at = place(spark, "windows")
    out = flows.to_files(flows.windowed_counts(flows.event_stream(spark, sf_dir), ["event_type"], "1 hour", "6 hours"), f"{at}/out", f"{at}/state")
    return out.select("event_type", "start_ms", "n")


@R.add("stream_late", """
SELECT user_id, CASE WHEN done IS NULL THEN 'expired' ELSE 'closed' END AS outcome, coalesce(done, first + 864000000) AS at FROM (
  SELECT user_id, min(epoch_us(ts) // 1000) AS first, min(epoch_us(ts) // 1000) FILTER (event_type = 'signup' AND value > 90) AS done, max(max(epoch_us(ts) // 1000)) OVER () AS last FROM events GROUP BY user_id)
WHERE done IS NOT NULL OR first + 864000000 < last - 3600000""")  # fmt: skip
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose large sign-up came, or didn't within ten days of their first event by the stream's own clock."""
    at = place(spark, "late")
    events = flows.event_stream(spark, sf_dir).withColumn("event_type", F.when((F.col("event_type") == "signup") & (F.col("value") > 90), "done").otherwise("other")).select("ts", "user_id", "event_type")
    return flows.to_files(flows.recover_late(events, "user_id", "done", 864_000_000), f"{at}/out", f"{at}/state")


@R.add("scrapes_ingested", """
SELECT 'activity' AS sink, count(*) AS n FROM pages UNION ALL SELECT 'scrapes', count(*) FROM pages
UNION ALL SELECT 'jobs', count(DISTINCT CASE WHEN page_id % 2 = 0 THEN page_id END) FROM pages UNION ALL SELECT 'ignored', count(DISTINCT CASE WHEN page_id % 2 = 1 THEN page_id END) FROM pages""")  # fmt: skip
def scrapes_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sink of an ingest's batch, read back from its own folder."""
    at = place(spark, "ingest")
    title = F.concat(F.when(F.col("page_id") % 2 == 0, "Platform Engineer ").otherwise("Office Manager "), F.col("page_id").cast("string"))
    job = F.struct(title.alias("title"), F.concat(F.lit("https://jobs.example.com/jobs/"), F.col("page_id").cast("string")).alias("url"), F.lit("Austin, TX").alias("location"))
    scrapes = _table(spark, sf_dir, "pages").select(F.to_json(F.struct(F.array(job).alias("items"))).alias("payload"), F.col("url").alias("sourceUrl"), F.col("page_id").alias("startedAt"), F.col("page_id").alias("completedAt"))
    stored = spark.createDataFrame([], "url string, title string, company string, location string, level string, remote boolean, totalCompensation double, compensationUnknown boolean, postedAt long, postedAtUnknown boolean, engineer boolean, sourceUrl string, startedAt long, completedAt long")
    gate = filters.passes_gate("title", "location", ["engineer"], [], [])
    ingest.batch_writer(at, lambda: stored, gate, 0)(scrapes, 0)
    sinks = [spark.read.parquet(f"{at}/{s}").agg(F.count("*").alias("n")).select(F.lit(s).alias("sink"), "n") for s in ("activity", "scrapes", "jobs", "ignored")]
    return sinks[0].union(sinks[1]).union(sinks[2]).union(sinks[3])
