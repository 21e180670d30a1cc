"""Queries of text search, merged result lists, and the newest scrape as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.operators import asof, search
from harborlight.plans.registry import Registry

R = Registry()

_RANKED = r"""
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS token FROM documents),
p AS (SELECT token, doc_id, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum((1 + ln(tf)) * ln(((SELECT count(*) FROM documents) + 1) / df)), 6) AS score FROM q JOIN d USING (token) JOIN p USING (token) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _answers(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = search.TextIndex.build(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", k)


@R.add("document_search", f"WITH {_RANKED} SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that fit each benchmark passage best, by the postings of its tokens."""
    return _answers(spark, sf_dir, 10).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@R.add("search_lists_merged", f"""
WITH {_RANKED}, l AS (SELECT item_id, doc_id, 0 AS no, rank FROM r WHERE rank <= 6 UNION ALL SELECT item_id - 1, doc_id, 1, rank FROM r WHERE rank <= 6),
f AS (SELECT item_id, doc_id, min((no, rank)) AS place FROM l GROUP BY ALL) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY place, doc_id)::INTEGER AS position, doc_id FROM f""")  # fmt: skip
def search_lists_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's answers with the next passage's behind them, a document at its first place."""
    a = _answers(spark, sf_dir, 6).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank")
    both = a.withColumn("no", F.lit(0)).unionByName(a.withColumn("item_id", F.col("item_id") - 1).withColumn("no", F.lit(1)))
    return search.merged_lists(both, "item_id", "no", "rank", "doc_id")


_BACK, _BUCKET = 40 * 3_600_000, 12 * 3_600_000
_OLD = "CASE event_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' WHEN 2 THEN 'n/a' ELSE 'known' END"
_NEW = "CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN ' ' ELSE 'seen ' || event_type END"


@R.add("jobs_reparsed", f"""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), l AS (SELECT event_id, user_id, ms, {_OLD} AS label FROM e WHERE event_type = 'purchase'),
h AS (SELECT l.event_id, max((e.ms, e.event_id, {_NEW.replace('event_id', 'e.event_id').replace('event_type', 'e.event_type')})) AS hit FROM l JOIN e ON e.user_id = l.user_id AND e.event_type <> 'purchase' AND e.ms BETWEEN l.ms - {_BACK} AND l.ms GROUP BY l.event_id),
j AS (SELECT l.event_id, label, hit[1] AS seen_ms, trim(hit[3]) AS new FROM l LEFT JOIN h USING (event_id))
SELECT event_id, seen_ms, CASE WHEN new IS NOT NULL AND new <> '' AND new <> label AND NOT (new = 'unknown' AND label NOT IN ('Unknown', '', 'n/a')) THEN new ELSE label END AS label FROM j""")  # fmt: skip
def jobs_reparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's purchases take the label of the newest other event within forty hours before, where it says more."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    jobs = e.where("event_type = 'purchase'").select("event_id", "user_id", "ms", F.expr(_OLD).alias("label"))
    scrapes = e.where("event_type <> 'purchase'").select("user_id", "ms", "event_id", F.expr(_NEW).alias("new"))
    out = asof.newest_before(jobs, scrapes, "user_id", "event_id", "ms", "ms", _BACK, _BUCKET)
    return out.select("event_id", F.col("hit.ms").alias("seen_ms"), asof.guarded(F.col("label"), F.trim("hit.new")).alias("label"))
