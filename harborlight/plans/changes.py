"""Mutation and migration queries over the driver's tables, through the merge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import oracle, shape
from harborlight.functions import company, text
from harborlight.operators import merge, rollups
from harborlight.plans.registry import Registry

R = Registry()


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.add("upsert_customers", """
SELECT coalesce(c_custkey, d.k) AS c_custkey, coalesce(d.name, c_name) AS c_name, CASE WHEN d.k IS NULL THEN c_acctbal WHEN c_custkey IS NULL THEN d.bal ELSE c_acctbal + d.bal END AS c_acctbal
FROM customer FULL JOIN (SELECT s_suppkey * 3 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, s_acctbal AS bal FROM supplier) d ON c_custkey = d.k""")  # fmt: skip
def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    delta = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return merge.upsert(base, delta, ["c_custkey"], {"c_acctbal": F.col("c_acctbal") + F.col("d_c_acctbal")})


@R.add("merge_with_delete", "SELECT s_suppkey * 3 AS c_custkey, coalesce(s_name, c_name) AS c_name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 3")
def merge_with_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge in which keys that the delta lacks go, as in a full refresh of a summary table."""
    base = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.upsert(base, _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.col("s_name").alias("c_name")), ["c_custkey"], delete_absent=True)


@R.add("patch_jobs", oracle("SELECT _id, CASE WHEN _id IN (SELECT jobId FROM applications WHERE status = 'rejected') THEN true ELSE compensationUnknown END AS compensationUnknown FROM jobs", "jobs", "applications"))
def patch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = shape(spark, sf_dir, "jobs").select("_id", "compensationUnknown")
    keys = shape(spark, sf_dir, "applications").where("status = 'rejected'").select(F.col("jobId").alias("_id"))
    return merge.patch(jobs, keys, ["_id"], {"compensationUnknown": F.lit(True)}).select("_id", "compensationUnknown")


@R.add("delete_jobs", oracle("SELECT _id FROM jobs WHERE _id NOT IN (SELECT jobId FROM applications WHERE status = 'rejected') AND NOT (compensationUnknown AND remote)", "jobs", "applications"))
def delete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = shape(spark, sf_dir, "jobs")
    keys = shape(spark, sf_dir, "applications").where("status = 'rejected'").select(F.col("jobId").alias("_id"))
    return merge.delete_where(merge.delete_keys(jobs, keys, ["_id"]), F.col("compensationUnknown") & F.col("remote")).select("_id")


@R.add("cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = merge.cascade(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("o_orderpriority") == "1-URGENT")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@R.add("orphan_lines", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)")
def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return merge.orphans(lines, _t(spark, sf_dir, "orders").where("o_orderkey % 10 <> 3"), "l_orderkey", "o_orderkey")


@R.add("repair_references", """
SELECT l_linenumber, CASE WHEN l_orderkey % 10 < 7 THEN l_orderkey ELSE l_orderkey - 7 END AS jobId, l_orderkey AS was FROM lineitem WHERE l_orderkey % 10 < 7 OR (l_orderkey % 10 IN (7, 8) AND l_orderkey - 7 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 < 7))""")  # fmt: skip
def repair_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to missing rows follow one hop or go."""
    orders = _t(spark, sf_dir, "orders")
    lines = _t(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("jobId"), F.col("l_orderkey").alias("was"))
    hops = orders.where("o_orderkey % 10 in (7, 8)").select(F.col("o_orderkey").alias("old"), (F.col("o_orderkey") - 7).alias("new"))
    return merge.repaired(lines, orders.where("o_orderkey % 10 < 7").select(F.col("o_orderkey").alias("_id")), hops, "jobId").select("l_linenumber", "jobId", "was")


@R.add("split_details", oracle("SELECT _id AS jobId, totalCompensation, currencyCode FROM jobs", "jobs"))
def split_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, details = merge.split_columns(shape(spark, sf_dir, "jobs"), "_id", ["totalCompensation", "currencyCode"], "jobId")
    return details


@R.add("backfill_changed", oracle("SELECT _id, NOT engineer AS was_set FROM jobs WHERE engineer <> (lower(trim(title)) IN ('', 'n/a') OR contains(lower(title), 'engineer'))", "jobs"))
def backfill_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputes a derived flag and returns only the rows that it changes."""
    jobs = shape(spark, sf_dir, "jobs").select("_id", "title", "engineer")
    after = jobs.withColumn("engineer", text.engineer_flag("title"))
    return merge.changed_rows(jobs, after, "_id").select("_id", F.col("engineer").alias("was_set"))


@R.add("alias_outer_merge", "SELECT coalesce(n_nationkey, s_nationkey) AS k, coalesce(n_name, s_name) AS name FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) FULL JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def alias_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _t(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    right = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"))
    return rollups.full_merge(left, right, "k", ["name"])


@R.add("count_by_parent", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def count_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with a pre-aggregated count, 0 where there is none."""
    per = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return _t(spark, sf_dir, "nation").join(per, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@R.add("company_resolution", oracle("""
SELECT _id, CASE WHEN _id LIKE '%1' THEN 'Alias Co' WHEN company = 'Unknown' THEN 'Example' ELSE company END AS resolved FROM jobs""", "jobs"))
def company_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = shape(spark, sf_dir, "jobs")
    alias = F.when(F.col("_id").endswith("1"), "Alias Co")
    return jobs.select("_id", company.resolve_company(alias, F.lit(None).cast("string"), F.col("company"), F.col("url")).alias("resolved"))


@R.add("latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(*) AS n FROM orders GROUP BY o_custkey")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"), F.count("*").alias("n"))


@R.add("regex_registry", "SELECT source AS domain, lang AS field, count(*) AS successCount, max(doc_id) AS last_id FROM documents WHERE contains(text, 'tion') GROUP BY ALL")
def regex_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a learned pattern by domain and field, an additive merge by group."""
    hits = _t(spark, sf_dir, "documents").where(F.col("text").contains("tion"))
    return hits.groupBy(F.col("source").alias("domain"), F.col("lang").alias("field")).agg(F.count("*").alias("successCount"), F.max("doc_id").alias("last_id"))
