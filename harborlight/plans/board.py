"""Job-board queries: rollups, search, grouping, applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import oracle, shape
from harborlight.functions import company, location, pay, text
from harborlight.operators import filters, rollups
from harborlight.plans.registry import Registry

R = Registry()
_UNKNOWN = "lower(trim(coalesce({c}, ''))) IN ('', 'unknown', 'n/a', 'na', 'unspecified', 'not available')"
_BAD = _UNKNOWN.format(c="company")
_KEY = (
    "replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(company), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')),"
    " '( (inc|incorporated|corp|corporation|co|company|llc|llp|ltd|limited|plc|i n c|c o|l l c|l l p|l t d|p l c))+$', ''), ' ', '')"
)
_USD = "CASE WHEN upper(trim(currencyCode)) IN ('USD', 'US$', '$', 'USD$') THEN 'USD' END"
_KNOWN = "NOT compensationUnknown AND totalCompensation > 0"


@R.add("company_summaries", oracle(f"""
SELECT key, count(*) AS n_jobs, arg_min(trim(company), (length(trim(company)), _creationTime, _id)) AS name, arg_min(trim(url), (_creationTime, _id)) AS sample_url,
  max({_USD}) AS currency,
  floor(avg(totalCompensation) FILTER ({_KNOWN} AND usd = 'USD' AND level = 'junior') + 0.5) AS avg_junior, floor(avg(totalCompensation) FILTER ({_KNOWN} AND usd = 'USD' AND level = 'mid') + 0.5) AS avg_mid,
  floor(avg(totalCompensation) FILTER ({_KNOWN} AND usd = 'USD' AND level = 'senior') + 0.5) AS avg_senior, max(postedAt) AS last_posted, max(scrapedAt) AS last_scraped
FROM (SELECT *, {_KEY} AS key, {_USD} AS usd FROM jobs WHERE NOT {_BAD}) GROUP BY key""", "jobs"))  # fmt: skip
def company_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.company_summaries(shape(spark, sf_dir, "jobs"))


@R.add("search_companies", oracle(f"SELECT arg_min(trim(company), (_creationTime, _id)) AS name, count(*) AS n_jobs FROM jobs WHERE NOT {_BAD} GROUP BY lower(trim(company)) ORDER BY n_jobs DESC, name LIMIT 50", "jobs"))
def search_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.search_companies(shape(spark, sf_dir, "jobs"), 50)


@R.add("company_pay_maxima", oracle(f"""
SELECT CASE WHEN grouping(co) = 0 THEN co END AS company, level, max(totalCompensation) AS top FROM (SELECT trim(company) AS co, * FROM jobs WHERE {_KNOWN} AND NOT {_BAD})
GROUP BY GROUPING SETS ((co, level), (level))""", "jobs"))  # fmt: skip
def company_pay_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.pay_maxima(shape(spark, sf_dir, "jobs"))


@R.add("company_pay_caps", oracle("""
SELECT company, r0 AS cap_junior, greatest(r0, r1) AS cap_mid, greatest(r0, r1, r2) AS cap_senior, greatest(r0, r1, r2, r3) AS cap_staff FROM (
  SELECT key, round_even(coalesce(junior, c_mid * q0) / 1000, 0)::BIGINT * 1000 AS r0, round_even(c_mid / 1000, 0)::BIGINT * 1000 AS r1, round_even(coalesce(senior, c_mid * q2) / 1000, 0)::BIGINT * 1000 AS r2, round_even(coalesce(staff, c_mid * q3) / 1000, 0)::BIGINT * 1000 AS r3
  FROM (SELECT *, coalesce(mid, senior / q2, staff / q3, junior / q0, m1) AS c_mid FROM w, (SELECT median(junior) / median(mid) AS q0, median(senior) / median(mid) AS q2, median(staff) / median(mid) AS q3, median(mid) AS m1 FROM w))
) JOIN (SELECT key, arg_max(company, (regexp_matches(company, '^[A-Z]'), len(regexp_extract_all(company, '[A-Z]')) > 0, len(regexp_extract_all(company, '[A-Z]')), -length(company), lower(company))) AS company FROM k GROUP BY key) USING (key)""", "jobs", ctes=f"""
k AS (SELECT trim(company) AS company, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS key, level, max(totalCompensation) AS top FROM jobs WHERE {_KNOWN} AND NOT {_BAD} GROUP BY ALL),
w AS (SELECT key, max(top) FILTER (level = 'junior') AS junior, max(top) FILTER (level = 'mid') AS mid, max(top) FILTER (level = 'senior') AS senior, max(top) FILTER (level = 'staff') AS staff FROM k GROUP BY key)"""))  # fmt: skip
def company_pay_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.pay_caps(rollups.pay_maxima(shape(spark, sf_dir, "jobs")))


@R.add("job_search", oracle("""
SELECT _id, title, postedAt FROM jobs WHERE remote AND engineer AND (compensationUnknown OR NOT totalCompensation > 0 OR totalCompensation BETWEEN 60000 AND 250000) AND country IN ('United States', 'Unknown')
ORDER BY postedAt DESC, scrapedAt DESC, _id LIMIT 50""", "jobs"))  # fmt: skip
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = filters.job_filter(remote=True, engineer=True, least=60_000, most=250_000, country="United States")
    return shape(spark, sf_dir, "jobs").where(test).orderBy(F.desc("postedAt"), F.desc("scrapedAt"), "_id").limit(50).select("_id", "title", "postedAt")


@R.add("job_filter_all", oracle(f"""
SELECT _id, company FROM jobs WHERE {_KNOWN} AND totalCompensation >= 100000 AND country <> 'United States' AND {_KEY} IN ('machinerynation9', 'buildingnation1', 'householdnation12', 'furniturenation17')""", "jobs"))  # fmt: skip
def job_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["machinerynation9", "buildingnation1", "householdnation12", "furniturenation17"]
    return shape(spark, sf_dir, "jobs").where(filters.job_filter(hide_unknown=True, least=100_000, country="Other", companies=names)).select("_id", "company")


@R.add("job_keyset_page", oracle("SELECT _id, postedAt FROM jobs WHERE postedAt < 900000000000 OR (postedAt = 900000000000 AND _id > 'o5') ORDER BY postedAt DESC, _id LIMIT 51", "jobs"))
def job_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor (postedAt, _id): one row more than the page tells whether it is the last."""
    after = (F.col("postedAt") < 900_000_000_000) | ((F.col("postedAt") == 900_000_000_000) & (F.col("_id") > "o5"))
    return shape(spark, sf_dir, "jobs").where(after).orderBy(F.desc("postedAt"), "_id").limit(51).select("_id", "postedAt")


@R.add("job_title_search", oracle("""
SELECT _id, len(list_intersect(list_distinct(regexp_split_to_array(lower(title), '[^a-z0-9]+')), ['senior', 'engineer', 'data'])) AS score FROM jobs
WHERE score > 0 AND level = 'senior' ORDER BY score DESC, postedAt DESC, _id LIMIT 100""", "jobs"))  # fmt: skip
def job_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-overlap score over titles with an equality filter, the newest first among equals."""
    wanted = F.array(*map(F.lit, ["senior", "engineer", "data"]))
    score = F.size(F.array_intersect(F.split(F.lower("title"), "[^a-z0-9]+"), wanted)).cast("long")
    return shape(spark, sf_dir, "jobs").where("level = 'senior'").withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("postedAt"), "_id").limit(100).select("_id", "score")


@R.add("job_groups", oracle(f"""
SELECT lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) || '|' || lower(regexp_replace(trim(company), '\\s+', ' ', 'g')) || '|' || level || '|' || CASE WHEN remote THEN 'remote' ELSE 'onsite' END AS group_key,
  arg_max(_id, (postedAt, scrapedAt, _id)) AS base_id, max(totalCompensation) FILTER ({_KNOWN}) AS best_pay,
  coalesce(array_to_string(list_sort(list_distinct(list(trim(location)) FILTER (NOT {_UNKNOWN.format(c="location")}))), ';'), '') AS places, count(*) AS n_jobs
FROM jobs GROUP BY 1""", "jobs"))  # fmt: skip
def job_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.board_groups(shape(spark, sf_dir, "jobs"))


@R.add("jobs_not_applied", oracle("SELECT _id FROM jobs WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.jobId = jobs._id AND a.userId = jobs.userId)", "jobs", "applications"))
def jobs_not_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = shape(spark, sf_dir, "applications").select(F.col("jobId").alias("_id"), "userId")
    return shape(spark, sf_dir, "jobs").join(mine, ["_id", "userId"], "left_anti").select("_id")


def _by_status(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    mine = shape(spark, sf_dir, "applications").where(F.col("status") == status)
    jobs = shape(spark, sf_dir, "jobs")
    return mine.join(jobs.drop("userId"), mine.jobId == jobs._id).orderBy(F.desc("appliedAt"), "_id").select("_id", "title", "appliedAt")


@R.add("applied_jobs", oracle("SELECT _id, title, appliedAt FROM applications JOIN jobs ON jobId = _id WHERE status = 'applied'", "jobs", "applications"))
def applied_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_status(spark, sf_dir, "applied")


@R.add("rejected_jobs", oracle("SELECT _id, title, appliedAt FROM applications JOIN jobs ON jobId = _id WHERE status = 'rejected'", "jobs", "applications"))
def rejected_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_status(spark, sf_dir, "rejected")


@R.add("applied_counts", oracle("SELECT _id, count(DISTINCT a.userId) FILTER (a.status = 'applied') AS n_applied FROM jobs LEFT JOIN applications a ON jobId = _id GROUP BY _id", "jobs", "applications"))
def applied_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = shape(spark, sf_dir, "applications").where("status = 'applied'").groupBy(F.col("jobId").alias("_id")).agg(F.countDistinct("userId").alias("n_applied"))
    return shape(spark, sf_dir, "jobs").select("_id").join(per, "_id", "left").fillna(0, ["n_applied"])


@R.add("job_flags", oracle(f"""
SELECT _id, {_UNKNOWN.format(c="title")} OR contains(lower(title), 'engineer') AS is_engineer, {_UNKNOWN.format(c="title")} AS unknown_title, {_KEY} AS filter_key,
  CASE WHEN contains(lower(title), 'junior') THEN 'junior' WHEN contains(lower(title), 'staff') THEN 'staff' WHEN contains(lower(title), 'senior') THEN 'senior' ELSE 'mid' END AS store_level,
  CASE WHEN contains(lower(title), 'staff') THEN 'staff' WHEN contains(lower(title), 'senior') OR contains(lower(title), 'manager') THEN 'senior' WHEN contains(lower(title), 'junior') THEN 'junior' ELSE 'mid' END AS ingest_level
FROM jobs""", "jobs"))  # fmt: skip
def job_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "jobs").select(
        "_id", text.engineer_flag("title").alias("is_engineer"), text.is_unknown_title("title").alias("unknown_title"), company.filter_key("company").alias("filter_key"),
        pay.level_from_hint("title").alias("store_level"), pay.level_at_ingest(F.lit(None).cast("string"), F.col("title")).alias("ingest_level"),
    )


@R.add("job_titles", oracle("""
SELECT _id, CASE WHEN regexp_matches(title, '^.+? - Remote$') THEN regexp_extract(title, '^(.+?) - Remote$', 1) WHEN title = 'n/a' THEN NULL ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS listing_title,
  regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM jobs""", "jobs"))  # fmt: skip
def job_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "jobs").select("_id", text.listing_title("title").alias("listing_title"), text.slug("title").alias("slug"))


@R.add("job_places", oracle("""
SELECT _id, CASE WHEN location IN ('Austin, TX', 'San Francisco, California; Berlin', 'Remote', 'unknown') THEN 'United States' WHEN location LIKE 'London%' THEN 'United Kingdom' WHEN location LIKE 'Toronto%' THEN 'Canada' WHEN location LIKE 'Berlin%' THEN 'Germany' END AS first_country,
  CASE WHEN location = 'Austin, TX' THEN 'Texas' WHEN location LIKE 'San%' THEN 'California' ELSE '' END AS states,
  array_to_string(list_transform(string_split(location, ';'), lambda x: trim(x)), '|') AS places, location IN ('Austin, TX', 'San Francisco, California; Berlin', 'Remote') AS usa
FROM jobs""", "jobs"))  # fmt: skip
def job_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = shape(spark, sf_dir, "jobs").withColumn("p", location.split_places("location"))
    return jobs.select(
        "_id", F.try_element_at(location.countries_of(F.col("p")), F.lit(1)).alias("first_country"), F.array_join(location.states_of(F.col("p")), ",").alias("states"), F.array_join("p", "|").alias("places"),
        location.matches_usa("location", ["london", "ontario", "germany"], ["austin"]).alias("usa"),
    )


@R.add("job_place_dictionary", oracle("""
SELECT _id, CASE location WHEN 'Austin, TX' THEN 'Austin, Texas' WHEN 'London, United Kingdom' THEN 'London, United Kingdom' WHEN 'Remote' THEN 'Remote' WHEN 'San Francisco, California; Berlin' THEN 'San Francisco, California'
  WHEN 'Toronto, Ontario' THEN 'Toronto, Ontario' WHEN 'Berlin, Germany' THEN 'Berlin, Germany' WHEN 'NYC' THEN 'New York, New York' ELSE 'Unknown' END AS label FROM jobs""", "jobs"))  # fmt: skip
def job_place_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places meet the dictionary by phrase; jobs take the result by place."""
    jobs = shape(spark, sf_dir, "jobs")
    places = jobs.select("location").distinct().withColumn("row_id", F.col("location"))
    found = location.resolve_places(places, "location", location.dictionary(spark))
    named = found.select("location", location.label(F.col("place.city"), F.col("place.state"), F.col("place.country")).alias("label"))
    return jobs.join(named, "location", "left").select("_id", "label")


@R.add("country_options", oracle("SELECT DISTINCT country AS country, CASE country WHEN 'United States' THEN 0 WHEN 'Unknown' THEN 2 ELSE 1 END AS pin FROM jobs", "jobs"))
def country_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct countries with a pinned head and tail."""
    pin = F.when(F.col("country") == "United States", 0).when(F.col("country") == "Unknown", 2).otherwise(1)
    return shape(spark, sf_dir, "jobs").select("country").distinct().withColumn("pin", pin).orderBy("pin", "country")


@R.add("pay_display", oracle("""
SELECT _id, '$' || CAST(floor(totalCompensation / 1000 + 0.5) AS BIGINT) || 'k' AS shown, CASE WHEN floor(totalCompensation) > 30000 AND floor(totalCompensation) < 5000000 THEN floor(totalCompensation)::BIGINT END AS bounded,
  CAST(floor(totalCompensation * 100000 + 0.5) AS BIGINT) AS milli_cents FROM jobs""", "jobs"))  # fmt: skip
def pay_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("totalCompensation")
    return shape(spark, sf_dir, "jobs").select("_id", pay.display_pay(c).alias("shown"), pay.bounded_pay(c).alias("bounded"), pay.cost_milli_cents(c).alias("milli_cents"))
