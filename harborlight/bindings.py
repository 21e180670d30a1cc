"""The driver's tables in the shapes that the operators take.

Each shape is one SELECT that Spark and DuckDB both run: {name} stands for a table, {ms:column} for a timestamp in
epoch milliseconds. The Spark side gets a DataFrame from it, the oracle a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The clock of all registered queries: 2024-01-20 00:00 UTC.
NOW_MS = 1_705_708_800_000

SHAPES = {
    "jobs": """
SELECT 'o' || CAST(o_orderkey AS STRING) AS _id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Staff Software Engineer' WHEN '2' THEN 'Senior Data Engineer - Remote' WHEN '3' THEN 'Product  Manager' WHEN '4' THEN 'n/a' ELSE 'Junior Web Developer' END AS title,
  CASE WHEN o_custkey % 11 = 0 THEN 'Unknown' WHEN o_orderkey % 3 = 0 THEN c_mktsegment || ' ' || n_name || ', Inc.' WHEN o_orderkey % 3 = 1 THEN lower(c_mktsegment) || ' ' || n_name || ' L L C' ELSE c_mktsegment || ' ' || n_name END AS company,
  CAST(NULL AS STRING) AS companyKey,
  CASE n_nationkey % 8 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'London, United Kingdom' WHEN 2 THEN 'Remote' WHEN 3 THEN 'San Francisco, California; Berlin' WHEN 4 THEN 'Toronto, Ontario' WHEN 5 THEN 'Berlin, Germany' WHEN 6 THEN 'NYC' ELSE 'unknown' END AS location,
  CASE n_nationkey % 8 WHEN 1 THEN 'United Kingdom' WHEN 4 THEN 'Canada' WHEN 5 THEN 'Germany' WHEN 7 THEN 'Unknown' ELSE 'United States' END AS country,
  o_orderstatus = 'F' AS remote,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'staff' WHEN '2' THEN 'senior' WHEN '5' THEN 'junior' ELSE 'mid' END AS level,
  o_totalprice AS totalCompensation,
  o_orderkey % 9 = 0 AS compensationUnknown,
  CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN ' us$ ' WHEN 2 THEN '$' ELSE 'EUR' END AS currencyCode,
  'https://Jobs.' || lower(c_mktsegment) || '.example.com/jobs/' || CAST(o_orderkey AS STRING) || '/' AS url,
  substr(o_orderpriority, 1, 1) IN ('1', '2', '4') AS engineer,
  {ms:o_orderdate} AS postedAt, {ms:o_orderdate} + (o_orderkey % 97) * 60000 AS scrapedAt, {ms:o_orderdate} + o_orderkey AS _creationTime,
  o_custkey AS userId
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
""",
    "queue": """
SELECT 'https://site' || CAST(user_id % 17 AS STRING) || '.example.com/jobs/' || CAST(event_id AS STRING) AS url,
  'https://site' || CAST(user_id % 17 AS STRING) || '.example.com/careers' AS sourceUrl,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE 's' || CAST(user_id % 17 AS STRING) END AS siteId,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
  event_id % 5 AS attempts, {ms:ts} AS createdAt,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE {ms:ts} + (event_id % 600) * 60000 END AS updatedAt,
  {ms:ts} + (event_id % 48) * 3600000 AS scheduledAt, event_id
FROM {events}
""",
    "applications": """
SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING) AS jobId, o_custkey AS userId, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'applied' END AS status, {ms:l_shipdate} AS appliedAt
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_returnflag IN ('A', 'R')
""",
    "sites": """
SELECT 's' || CAST(s_suppkey AS STRING) AS siteId, s_name AS name, lower(n_name) || '.example.com' AS domain, s_suppkey % 3 = 0 AS completed, s_suppkey % 4 = 0 AS failed,
  1705708800000 - s_suppkey % 50 * 3600000 AS lastRunAt, 1705708800000 - s_suppkey % 70 * 1800000 AS lastFailureAt,
  CASE WHEN s_suppkey % 7 = 0 THEN 1705708800000 + 60000 END AS lockedUntil, CASE WHEN s_suppkey % 5 <> 0 THEN 1705708800000 + (s_suppkey % 9 - 4) * 60000 END AS nextRunAt, s_nationkey AS nationkey
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
""",
    "filters": """
SELECT 'f' || CAST(o_orderkey AS STRING) AS id, o_custkey AS userId, o_orderpriority AS name, {ms:o_orderdate} AS createdAt, o_orderkey % 8 = 0 AS selected FROM {orders}
""",
    "postings": """
SELECT page_id, url, html, page_id % 10 AS source_id FROM {pages}
""",
    "runs": """
SELECT 'r' || CAST(event_id AS STRING) AS runId, user_id AS workerId, event_type AS kind, {ms:ts} AS at_ms, value AS cost, props AS payload, 'site' || CAST(user_id % 17 AS STRING) AS site, event_id FROM {events}
""",
}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"\{ms:(\w+)\}", r"unix_millis(CAST(\1 AS TIMESTAMP))", SHAPES[name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def oracle(sql: str, *names: str, ctes: str = "") -> str:
    """The SQL with the named shapes as common table expressions in front."""
    parts = []
    for n in names:
        body = re.sub(r"\{ms:(\w+)\}", r"(epoch_us(\1) // 1000)", SHAPES[n])
        parts.append(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', body)})")
    parts += [ctes] if ctes else []
    return (f"WITH {', '.join(parts)} " if parts else "") + sql
