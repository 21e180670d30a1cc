"""Group-by operators: company summaries, pay maxima and caps, counts and board groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harborlight.functions import company, pay, text
from harborlight.functions.base import lower, trim, truthy


def company_summaries(jobs: DataFrame) -> DataFrame:
    """One row for each company key: count, shortest name, first address, dollar averages by level, newest times."""
    known = jobs.where(~text.is_unknown_label("company"))
    rows = known.withColumn("key", F.coalesce(F.nullif(trim("companyKey"), F.lit("")), company.company_key("company"))).withColumn("name", trim("company"))
    order = F.struct("_creationTime", "_id")
    good = ~truthy("compensationUnknown") & (F.col("totalCompensation") > 0) & (pay.usd("currencyCode") == "USD")
    mean = lambda level: F.round(F.avg(F.when(good & (F.col("level") == level), F.col("totalCompensation")))).alias(f"avg_{level}")
    return rows.groupBy("key").agg(
        F.count("*").alias("n_jobs"),
        F.min_by("name", F.struct(F.length("name"), "_creationTime", "_id")).alias("name"),
        F.min_by(F.nullif(trim("url"), F.lit("")), F.when(trim("url") != "", order)).alias("sample_url"),
        F.max(pay.usd("currencyCode")).alias("currency"),
        *(mean(v) for v in ("junior", "mid", "senior")),
        F.nullif(F.max("postedAt"), F.lit(0)).alias("last_posted"),
        F.nullif(F.max(F.coalesce("scrapedAt", "_creationTime")), F.lit(0)).alias("last_scraped"),
    )


def search_companies(jobs: DataFrame, most: int) -> DataFrame:
    """Companies by number of jobs: the first spelling of each, most first."""
    g = jobs.where(~text.is_unknown_label("company")).groupBy(lower(trim("company")).alias("k")).agg(F.count("*").alias("n_jobs"), F.min_by(trim("company"), F.struct("_creationTime", "_id")).alias("name"))
    return g.select("name", "n_jobs").orderBy(F.desc("n_jobs"), "name").limit(most)


def pay_maxima(jobs: DataFrame, least: float = 0) -> DataFrame:
    """Largest pay of each company and level, and of each level over all (company null), by grouping sets."""
    good = jobs.where(~truthy("compensationUnknown") & (F.col("totalCompensation") > least) & ~text.is_unknown_label("company"))
    rows = good.select(trim("company").alias("company"), "level", "totalCompensation")
    return rows.groupingSets([[F.col("company"), F.col("level")], [F.col("level")]], "company", "level").agg(F.max("totalCompensation").alias("top"))


def pay_caps(maxima: DataFrame, step: int = 1000) -> DataFrame:
    """Caps of every company: gaps filled from the middle level by the ratio of medians, rounded, never falling with the level."""
    rows = maxima.where("company is not null").select(company.alnum_key("company").alias("key"), "company", "level", "top").where("key <> '' and top > 0")
    name = rows.groupBy("key").agg(F.max_by(trim("company"), company.display_rank("company")).alias("company"))
    wide = rows.groupBy("key").pivot("level", pay.LEVELS).agg(F.max("top"))
    medians = wide.agg(*(F.coalesce(F.median(v), F.lit(0.0)).alias(f"m_{v}") for v in pay.LEVELS))
    both = wide.crossJoin(F.broadcast(medians))  # one row of medians
    ratio = lambda v: F.when(F.col("m_mid") > 0, F.col(f"m_{v}") / F.col("m_mid")).otherwise(1.0)
    usable = lambda v: F.when(ratio(v) > 0, F.col(v) / ratio(v))
    both = both.withColumn("c_mid", F.coalesce("mid", usable("senior"), usable("staff"), usable("junior"), "m_mid"))
    est = lambda v: F.coalesce(F.col(v), F.when((F.col("c_mid") > 0) & (ratio(v) > 0), F.col("c_mid") * ratio(v)), F.col(f"m_{v}"))
    both = both.select("key", *(pay.round_pay(F.col("c_mid") if v == "mid" else est(v), step).alias(f"r_{v}") for v in pay.LEVELS))
    caps, sofar = [], []
    for v in pay.LEVELS:
        sofar.append(F.col(f"r_{v}"))
        caps.append((F.greatest(*sofar) if len(sofar) > 1 else sofar[0]).alias(f"cap_{v}"))
    return both.select("key", *caps).join(name, "key").drop("key")


def pay_shown(jobs: DataFrame, caps: DataFrame) -> DataFrame:
    """Jobs with payShown, payUnknown, payEstimated and payReason; unknown pay falls back on the cap of the company at the job's level.

    caps are those of pay_caps; one without a middle level counts for nothing, and a job whose level is none of the four, or has no cap, takes the
    middle one. The reason says so, else it is the job's own compensationReason, else where the pay comes from (scrapedWith). Of several caps of one
    company the first by name counts; a job without a company has none.
    """
    levels = F.struct(*(F.col(f"cap_{v}").cast("double").alias(v) for v in pay.LEVELS))
    of = caps.where("cap_mid > 0").groupBy(company.alnum_key("company").alias("_key")).agg(F.min_by(levels, "company").alias("_caps")).where("_key <> ''")
    own = F.lower(trim(F.coalesce("level", F.lit(""))))
    met = jobs.withColumn("_key", company.alnum_key(F.coalesce("company", F.lit("")))).join(of, "_key", "left")
    unknown = truthy("compensationUnknown") | F.col("totalCompensation").isNull()
    at_level = F.coalesce(*(F.when((own == v) & (F.col(f"_caps.{v}") > 0), F.col(f"_caps.{v}")) for v in pay.LEVELS), F.col("_caps.mid"))
    estimate = F.when(unknown, at_level)
    said = lambda c: F.nullif(trim(F.col(c)), F.lit("")) if c in jobs.columns else F.lit(None).cast("string")
    capped = F.concat(F.lit("Company salary cap from config"), F.when(own.isin(pay.LEVELS), "").otherwise(" (mid-level fallback)"))
    source = F.coalesce(F.concat(said("scrapedWith"), F.lit(" extracted compensation")), F.lit("Compensation provided in listing"))
    reason = F.when(estimate.isNotNull(), capped).otherwise(F.coalesce(said("compensationReason"), F.when(unknown, pay.NO_PAY_REASON).otherwise(source)))
    shown = pay.money(F.when(unknown, estimate).otherwise(F.col("totalCompensation")), "currencyCode")
    return met.select(*jobs.columns, shown.alias("payShown"), (unknown & estimate.isNull()).alias("payUnknown"), estimate.isNotNull().alias("payEstimated"), reason.alias("payReason"))


def board_groups(jobs: DataFrame) -> DataFrame:
    """Jobs of one title, company, level and remoteness as one row: the newest as base, the best-paid for pay, merged places."""
    part = lambda c: F.regexp_replace(lower(trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    key = F.concat_ws("|", part("title"), part("company"), part("level"), F.when(truthy("remote"), "remote").otherwise("onsite"))
    newest = F.struct("postedAt", "scrapedAt", "_id")
    known = ~truthy("compensationUnknown") & (F.col("totalCompensation") > 0)
    g = jobs.withColumn("group_key", key).groupBy("group_key").agg(
        F.max_by("_id", newest).alias("base_id"),
        F.max(F.when(known, F.col("totalCompensation"))).alias("best_pay"),
        F.array_sort(F.collect_set(F.when(~text.is_unknown_label("location"), trim("location")))).alias("places"),
        F.count("*").alias("n_jobs"),
    )
    return g.withColumn("places", F.array_join("places", ";"))


def status_counts(rows: DataFrame, by: str, age_from: str, now_ms: int) -> DataFrame:
    """Rows by status, with the oldest and newest age in minutes."""
    age = lambda f: F.floor((F.lit(now_ms) - f(age_from)) / 60_000).cast("long")
    return rows.groupBy(by).agg(F.count("*").alias("n"), age(F.min).alias("oldest_min"), age(F.max).alias("newest_min"))


def merged_by_latest(rows: DataFrame, key: str, at: str, keep: list[str], union_of: str) -> DataFrame:
    """One row a key: columns of the latest row, and the distinct values of another column over all of them."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.struct(at, c)).alias(c) for c in keep), F.max(at).alias(at), F.array_join(F.array_sort(F.collect_set(union_of)), ",").alias("all_values"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def full_merge(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge in which the left's values win where both have one."""
    r = right.select(key, *(F.col(c).alias(f"_r_{c}") for c in columns))
    return left.select(key, *columns).join(r, key, "full_outer").select(key, *(F.coalesce(c, f"_r_{c}").alias(c) for c in columns))
