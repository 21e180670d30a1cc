"""Back-office lists and lookups: sites, scrapes, runs, saved filters, company names, retagging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import NOW_MS, oracle, shape
from harborlight.operators import views
from harborlight.plans.registry import Registry

R = Registry()
_ALIASES = "alias AS (SELECT lower(n_name) || '.example.com' AS domain, n_name || ' Works' AS alias FROM nation WHERE n_nationkey % 2 = 0)"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0")
    return n.select(F.concat(F.lower("n_name"), F.lit(".example.com")).alias("domain"), F.concat("n_name", F.lit(" Works")).alias("alias"))


@R.add("sites_successful", oracle("SELECT siteId, name, lastRunAt FROM sites WHERE completed ORDER BY lastRunAt DESC, siteId LIMIT 50", "sites"))
def sites_successful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.successful_sites(shape(spark, sf_dir, "sites"), 50).select("siteId", "name", "lastRunAt")


@R.add("sites_failed", oracle("SELECT siteId, name, lastFailureAt FROM sites WHERE failed AND NOT completed ORDER BY lastFailureAt DESC, siteId LIMIT 50", "sites"))
def sites_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.failed_sites(shape(spark, sf_dir, "sites"), 50).select("siteId", "name", "lastFailureAt")


@R.add("scrapes_by_source", oracle("SELECT url, sourceUrl, createdAt FROM queue ORDER BY sourceUrl DESC, createdAt DESC, url LIMIT 100", "queue"))
def scrapes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.by_source(shape(spark, sf_dir, "queue"), 100).select("url", "sourceUrl", "createdAt")


@R.add("scrape_errors", oracle("SELECT runId, at_ms FROM runs WHERE kind = 'error' ORDER BY at_ms DESC, runId LIMIT 25", "runs"))
def scrape_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.newest(shape(spark, sf_dir, "runs").where("kind = 'error'"), "at_ms", "runId", 25).select("runId", "at_ms")


@R.add("workflow_runs", oracle("SELECT runId, kind, at_ms FROM runs ORDER BY at_ms DESC, runId LIMIT 200", "runs"))
def workflow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit above 200 is held to 200."""
    return views.newest(shape(spark, sf_dir, "runs"), "at_ms", "runId", 10_000).select("runId", "kind", "at_ms")


@R.add("worker_latest", oracle("SELECT workerId, runId, kind, at_ms FROM runs WHERE workerId = 8 ORDER BY at_ms DESC, runId DESC LIMIT 1", "runs"))
def worker_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest_of(shape(spark, sf_dir, "runs").select("workerId", "at_ms", "runId", "kind"), "workerId", 8, "at_ms").select("workerId", "runId", "kind", "at_ms")


@R.add("webhooks_pending", oracle(f"SELECT runId AS id, at_ms AS receivedAt FROM runs WHERE kind = 'click' AND cost < 50 AND at_ms < {NOW_MS} ORDER BY at_ms, runId LIMIT 40", "runs"))
def webhooks_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shape(spark, sf_dir, "runs").select(F.col("runId").alias("id"), F.col("kind").alias("event"), F.col("at_ms").alias("receivedAt"), (F.col("cost") >= 50).alias("processed"))
    return views.pending_events(e, "click", NOW_MS, 40).select("id", "receivedAt")


@R.add("form_queue_head", oracle("SELECT jobId, userId FROM applications WHERE status = 'applied' ORDER BY appliedAt, jobId LIMIT 1", "applications"))
def form_queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = shape(spark, sf_dir, "applications")
    q = a.select(F.col("jobId").alias("id"), "userId", F.col("appliedAt").alias("queuedAt"), F.when(F.col("status") == "applied", "pending").otherwise("done").alias("status"))
    return views.next_in_line(q).select(F.col("id").alias("jobId"), "userId")


@R.add("scrape_history", oracle("""
SELECT site AS url, runId, rank FROM (SELECT site, runId, row_number() OVER (PARTITION BY site ORDER BY at_ms DESC, runId) AS rank FROM runs WHERE site IN (SELECT 'site' || n_nationkey FROM nation)) t WHERE rank <= 5""", "runs"))  # fmt: skip
def scrape_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string")).alias("url"), F.col("n_nationkey").alias("pos"))
    return views.history(shape(spark, sf_dir, "runs").withColumnRenamed("site", "url"), asked, "at_ms", "runId", 5).select("url", "runId", F.col("rank").cast("long").alias("rank"))


@R.add("run_requests", oracle("SELECT runId, siteId, name, alias AS company FROM (SELECT runId, 's' || workerId AS siteId FROM runs WHERE kind = 'purchase' ORDER BY at_ms DESC, runId LIMIT 100) r LEFT JOIN sites USING (siteId) LEFT JOIN alias USING (domain)", "runs", "sites", ctes=_ALIASES))
def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.newest(shape(spark, sf_dir, "runs").where("kind = 'purchase'"), "at_ms", "runId", 100).select("runId", F.concat(F.lit("s"), F.col("workerId").cast("string")).alias("siteId"))
    return views.with_alias(r, shape(spark, sf_dir, "sites"), _aliases(spark, sf_dir)).select("runId", "siteId", "name", "company")


@R.add("job_details", oracle("""
SELECT _id, CASE WHEN d.jid IS NOT NULL THEN 'detail ' || _id ELSE title END AS title, d.lines, coalesce(a.applied, 0) AS applied FROM jobs LEFT JOIN d ON _id = d.jid
LEFT JOIN (SELECT jobId, count(DISTINCT userId) AS applied FROM applications WHERE status = 'applied' GROUP BY 1) a ON _id = a.jobId""", "jobs", "applications", ctes="d AS (SELECT 'o' || l_orderkey AS jid, count(*) AS lines FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)"))  # fmt: skip
def job_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'N'").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("_id")).agg(F.count("*").alias("lines"))
    d = lines.withColumn("title", F.concat(F.lit("detail "), F.col("_id")))
    jobs = shape(spark, sf_dir, "jobs").select("_id", "title", "company")
    return views.job_details(jobs, d, shape(spark, sf_dir, "applications")).select("_id", "title", "lines", "applied")


@R.add("url_logs", oracle("SELECT s AS scrapeId, u AS url, _id AS jobId FROM (SELECT userId AS s, CASE WHEN n = 1 THEN rtrim(url, '/') ELSE url || 'x' END AS u FROM jobs, (VALUES (1), (2)) t(n)) e LEFT JOIN (SELECT rtrim(url, '/') AS k, min(_id) AS _id FROM jobs GROUP BY 1) j ON rtrim(u, '/') = k", "jobs"))
def url_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = shape(spark, sf_dir, "jobs")
    s = jobs.select(F.col("userId").alias("scrapeId"), F.col("scrapedAt").alias("at"), F.array(F.rtrim(F.col("url"), F.lit("/")), F.concat("url", F.lit("x"))).alias("urls"))
    return views.url_logs(s, jobs).select("scrapeId", "url", "jobId")


@R.add("jobs_retagged", oracle("SELECT _id, company AS was, n_name || ' Works' AS company FROM jobs JOIN customer ON userId = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 AND remote AND company <> n_name || ' Works'", "jobs"))
def jobs_retagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    jobs = shape(spark, sf_dir, "jobs").join(c.select("c_custkey", F.concat(F.lower("n_name"), F.lit(".example.com")).alias("home")), F.col("userId") == F.col("c_custkey"))
    return views.retagged(jobs, _aliases(spark, sf_dir), F.col("home"), F.col("remote"))


@R.add("ignored_companies", oracle("SELECT siteId, coalesce(nullif(CASE WHEN nationkey % 3 = 0 THEN '' ELSE name END, ''), alias, 'from ' || siteId) AS company FROM sites LEFT JOIN alias USING (domain)", "sites", ctes=_ALIASES))
def ignored_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, "sites").withColumn("company", F.when(F.col("nationkey") % 3 == 0, "").otherwise(F.col("name")))
    return views.filled_companies(rows, _aliases(spark, sf_dir), F.col("domain"), F.concat(F.lit("from "), F.col("siteId"))).select("siteId", "company")


@R.add("ignored_by_company", oracle("SELECT company, count(*) AS n, max(scrapedAt) AS latest FROM jobs WHERE engineer GROUP BY company", "jobs"))
def ignored_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ignored_groups(shape(spark, sf_dir, "jobs").where("engineer").withColumn("createdAt", F.col("scrapedAt")))


@R.add("schedule_states", oracle(f"SELECT state, count(*) AS n, min(siteId) AS sample FROM (SELECT siteId, CASE WHEN failed THEN 'failed' WHEN lockedUntil > {NOW_MS} THEN 'locked' WHEN nextRunAt IS NULL THEN 'unscheduled' WHEN nextRunAt <= {NOW_MS} THEN 'due' ELSE 'not_due' END AS state FROM sites) t GROUP BY state", "sites"))
def schedule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.schedule_summary(shape(spark, sf_dir, "sites"), NOW_MS)


@R.add("schedule_audit", oracle(f"SELECT 'site' AS kind, siteId, verdict, NULL::BIGINT AS sites, NULL::BIGINT AS due, NULL::BIGINT AS skipped FROM v UNION ALL SELECT 'summary', NULL, NULL, count(*), count(*) FILTER (verdict = 'due'), count(*) FILTER (verdict <> 'due') FROM v", "sites", ctes=f"v AS (SELECT siteId, CASE WHEN nextRunAt IS NULL THEN 'none' WHEN nextRunAt <= {NOW_MS} THEN 'due' ELSE 'later' END AS verdict FROM sites)"))
def schedule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("nextRunAt").isNull(), "none").when(F.col("nextRunAt") <= NOW_MS, "due").otherwise("later")
    return views.schedule_audit(shape(spark, sf_dir, "sites").select("siteId", verdict.alias("verdict")))


@R.add("live_not_seen", oracle("SELECT DISTINCT url FROM queue WHERE url NOT IN (SELECT url FROM queue WHERE status = 'completed')", "queue"))
def live_not_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = shape(spark, sf_dir, "queue").select("url", "status")
    return views.only_live(q.select("url"), q.where("status = 'completed'"), F.col("url")).distinct()


@R.add("pattern_counts", oracle("SELECT site AS domain, kind AS field, 'p' || (workerId % 3) AS regex, count(*) + coalesce(max(b.n), 0) AS successCount, max(at_ms) AS lastSuccessAt FROM runs LEFT JOIN (SELECT 'site0' AS d, 'click' AS k, 'p0' AS p, 10 AS n) b ON site = d AND kind = k AND 'p' || (workerId % 3) = p GROUP BY 1, 2, 3", "runs"))
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = shape(spark, sf_dir, "runs").select(F.col("site").alias("domain"), F.col("kind").alias("field"), F.concat(F.lit("p"), (F.col("workerId") % 3).cast("string")).alias("regex"), F.col("at_ms").alias("at"))
    stored = spark.createDataFrame([("site0", "click", "p0", 10, 0)], "domain string, field string, regex string, successCount long, lastSuccessAt long")
    return views.counted_patterns(stored, hits)


@R.add("filters_saved", oracle("""
SELECT id, userId, selected AND userId NOT IN (SELECT userId FROM neu) AS selected FROM filters WHERE selected OR name LIKE '1%' OR name LIKE '2%' OR name LIKE '3%' OR name LIKE '4%'
UNION ALL SELECT id, userId, row_number() OVER (PARTITION BY userId ORDER BY createdAt DESC, id DESC) = 1 FROM neu""", "filters", ctes="neu AS (SELECT * FROM filters WHERE NOT selected AND name LIKE '5%')"))  # fmt: skip
def filters_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = shape(spark, sf_dir, "filters")
    new = ~F.col("selected") & F.col("name").startswith("5")
    return views.save_filter(f.where(~new), f.where(new)).select("id", "userId", "selected")


@R.add("filter_chosen", oracle("SELECT id, filters.userId, CASE WHEN c.userId IS NULL THEN selected ELSE coalesce(id = c.id2, false) END AS selected FROM filters LEFT JOIN (SELECT userId, min(id) AS id2 FROM filters WHERE userId % 4 = 0 GROUP BY userId) c USING (userId)", "filters"))
def filter_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth user picks the least of their filters; the next user asks for it too, which changes nothing."""
    f = shape(spark, sf_dir, "filters")
    own = f.where("userId % 4 = 0").groupBy("userId").agg(F.min("id").alias("filterId"))
    foreign = own.select((F.col("userId") + 1).alias("userId"), "filterId")
    return views.select_filter(f, own.union(foreign)).select("id", "userId", "selected")


@R.add("filters_default", oracle("""
SELECT id, userId, selected OR (NOT bool_or(selected) OVER (PARTITION BY userId) AND row_number() OVER (PARTITION BY userId ORDER BY createdAt DESC, id DESC) = 1) AS selected FROM filters
UNION ALL SELECT 'default-' || c_custkey, c_custkey, true FROM customer WHERE c_custkey NOT IN (SELECT userId FROM filters)""", "filters"))  # fmt: skip
def filters_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("userId"))
    return views.default_filters(shape(spark, sf_dir, "filters"), users, NOW_MS).select("id", "userId", "selected")


@R.add("window_reset", oracle(f"SELECT 'queue' AS name, count(*) AS deleted FROM queue WHERE createdAt >= {NOW_MS} - 86400000 AND createdAt < {NOW_MS} UNION ALL SELECT 'runs', count(*) FROM runs WHERE at_ms >= {NOW_MS} - 86400000 AND at_ms < {NOW_MS}", "queue", "runs"))
def window_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.window_reset({"queue": (shape(spark, sf_dir, "queue"), "createdAt"), "runs": (shape(spark, sf_dir, "runs"), "at_ms")}, NOW_MS - 86_400_000, NOW_MS)[1]


@R.add("company_names", "SELECT n_name || ' Works, Inc.' AS input, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' Works, Inc.' END AS resolved, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|' || n_name || ' Works' ELSE n_name || ' Works, Inc.' END AS names FROM nation")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that are an alias of half of the profiles, and of none of the others."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    profiles = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat("n_name", F.lit(" Works")))).alias("aliases"))
    out = views.company_names(profiles, n.select(F.concat("n_name", F.lit(" Works, Inc.")).alias("input")))
    return out.select("input", "resolved", F.array_join("names", "|").alias("names"))
