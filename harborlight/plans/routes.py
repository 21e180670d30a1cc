"""Queries over rules by host and path, hosted companies and the paging of known sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions import url
from harborlight.operators import routes
from harborlight.plans.registry import Registry

R = Registry()
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@R.add("page_longest_rules", rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r AS (SELECT DISTINCT host AS rh, regexp_extract(path, '^/[^/]*/[0-9]?', 0) AS rp FROM p UNION SELECT DISTINCT regexp_extract(host, '[^.]*\.[^.]*$', 0), regexp_extract(path, '^/[^/]*', 0) FROM p UNION SELECT DISTINCT regexp_extract(host, '[^.]*$', 0), '/' FROM p)
SELECT page_id, rh AS rule_host, rp AS rule_path FROM (
  SELECT page_id, rh, rp, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC, rh || rp DESC) AS n FROM p LEFT JOIN r ON rh <> '' AND (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) WHERE n = 1""")  # fmt: skip
def page_longest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of the rules that the pages' own hosts, domains and endings make, some with paths down to a digit."""
    p = _pages(spark, sf_dir).select("page_id", url.host("url").alias("host"), url.path("url").alias("path"))
    own = p.select(F.col("host").alias("rule_host"), F.regexp_extract("path", "^/[^/]*/[0-9]?", 0).alias("rule_path"))
    domain = p.select(F.regexp_extract("host", r"[^.]*\.[^.]*$", 0), F.regexp_extract("path", "^/[^/]*", 0))
    ending = p.select(F.regexp_extract("host", "[^.]*$", 0), F.lit("/"))
    out = routes.longest_fit(p, own.union(domain).union(ending))
    return out.select("page_id", "fit.rule_host", "fit.rule_path")


#: Addresses on a hosting domain, by page_id % 4: the company in the path, behind words that name none, in the host, or nowhere.
_HOSTED = """CASE page_id % 4 WHEN 0 THEN 'https://boards.greenhouse.io/Team' || page_id % 50 || '/jobs/' || page_id WHEN 1 THEN 'https://apply.workable.com/jobs/' || page_id || '/shop' || page_id % 9 || '.org/x'
  WHEN 2 THEN 'https://jobs.firm' || page_id % 30 || '.wd5.myworkdayjobs.com/JobDetail/other' ELSE url END"""


@R.add("page_hosted_companies", rf"""
SELECT page_id, CASE WHEN u = url THEN NULL ELSE array_to_string(string_split({_HOST.replace('(url', '(u')}, '.')[-2:], '.') END AS hosted,
  CASE page_id % 4 WHEN 0 THEN regexp_extract(lower(u), '/(team[0-9]+)/', 1) || '.com' WHEN 1 THEN regexp_extract(u, '[^/]*\.org', 0) WHEN 2 THEN 'wd5.com' END AS company FROM (SELECT page_id, url, {_HOSTED} AS u FROM pages)""")  # fmt: skip
def page_hosted_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosting domain of each address and the company that it names there."""
    p = _pages(spark, sf_dir).select("page_id", F.expr(_HOSTED).alias("address")).withColumns({"host": url.host("address"), "path": url.path("address")})
    domains = spark.createDataFrame([(d, "") for d in routes.HOSTED_JOB_DOMAINS], "rule_host string, rule_path string")
    hosted = F.col("fit.rule_host")
    return routes.longest_fit(p, domains).select("page_id", hosted.alias("hosted"), routes.company_of_address("address", hosted).alias("company"))


_SITES = ", ".join(f"({i}, '{s}', '{h}', '{k}', '{p}', {n}, {f}, '{d}')" for i, (s, h, _, k, p, n, f, d) in enumerate(routes.SITE_RULES))
_LISTING = "'https://www.' || domain || '/search?' || CASE WHEN page_id % 3 = 0 THEN param || '=' || (first + CASE kind WHEN 'page' THEN 2 ELSE 2 * size END) || '&' ELSE '' END || 'q=' || page_id || '#top'"


@R.add("site_listing_pages", rf"""
WITH s(i, site, domain, kind, param, size, first, detail) AS (VALUES {_SITES}),
l AS (SELECT page_id, site, domain, kind, param, size, first, replace(detail, '{{id}}', page_id::VARCHAR) AS d, length(html) // 50 AS total, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS skip FROM pages JOIN s ON i = page_id % 9),
n AS (SELECT *, CASE kind WHEN 'page' THEN k + first ELSE k * size + first END AS page FROM (SELECT *, unnest(range(skip + 1, CAST(ceil(total / size) AS BIGINT))) AS k FROM l))
SELECT page_id, site, page::INTEGER AS page, 'https://www.' || domain || '/search?q=' || page_id || '&' || param || '=' || page AS next, 'https://www.' || domain || d AS detail FROM n""")  # fmt: skip
def site_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine sites' further pages from the first or the third, and the address of one job."""
    rules = spark.createDataFrame(routes.SITE_RULES, routes.SITE_SCHEMA)
    sites = spark.createDataFrame([(i, h, k, p, n, f) for i, (_, h, _, k, p, n, f, _) in enumerate(routes.SITE_RULES)], "i int, domain string, kind string, param string, size int, first int")
    p = _pages(spark, sf_dir).join(sites, F.col("page_id") % 9 == F.col("i"))
    p = p.select("page_id", F.expr(_LISTING).alias("address"), F.floor(F.length("html") / 50).cast("int").alias("total")).withColumns({"host": url.host("address"), "path": url.path("address")})
    out = routes.listing_pages(routes.longest_fit(p, rules), "address", "total")
    return out.select("page_id", "fit.site", "page", "next", routes.detail_address(F.col("host"), F.col("fit.detail"), F.col("page_id").cast("string")).alias("detail"))
