"""Readers of configuration and reference files, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions.base import col, lower, trim
from harborlight.functions.company import company_key
from harborlight.functions.url import SITE_TYPES, site_key

PROVIDERS = ["fetchfox", "firecrawl", "spidercloud", "fetchfox_spidercloud"]
SITES = (
    "site_schedules array<struct<url: string, name: string, enabled: boolean, type: string, scrapeProvider: string,"
    " schedule: struct<name: string, days: array<string>, startTime: string, intervalMinutes: double, timezone: string>>>"
)


def site_schedules(spark: SparkSession, path: str) -> DataFrame:
    """Site entries of a schedule file, one of each canonical key, the first."""
    rows = spark.read.schema(SITES).json(path, multiLine=True).select(F.posexplode("site_schedules").alias("pos", "e")).select("pos", "e.*")
    keyed = rows.withColumn("key", site_key("url", "type"))
    return keyed.groupBy("key").agg(F.min_by(F.struct(*rows.columns), "pos").alias("e")).select("key", "e.*")


def schedule_problems(days: Column, start: Column, interval: Column) -> Column:
    """Why a schedule is refused; null if it is sound."""
    return F.when(F.size(F.array_distinct(days)) < 1, "no day").when(~start.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "start time").when(interval < 1, "interval")


def fan_out(configs: DataFrame) -> DataFrame:
    """A schedule with a count n gives the ids id, id-2, ..., id-n."""
    n = F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))))
    return configs.withColumn("n", n).withColumn("id", F.when(F.col("n") == 1, F.col("id")).otherwise(F.concat("id", F.lit("-"), F.col("n").cast("string")))).drop("n", "count")


def pay_caps(rows: DataFrame) -> DataFrame:
    """The cap table (company, junior, mid, senior, staff) by company key; rows without a mid cap go."""
    return rows.where("mid is not null").withColumn("key", company_key("company")).drop("company")


def geo_cities(spark: SparkSession, path: str) -> DataFrame:
    """Cities of a GeoNames table: name, country code, first-level code, population."""
    t = spark.read.csv(path, sep="\t", quote="")
    return t.select(F.col("_c1").alias("city"), F.col("_c8").alias("country_code"), F.col("_c10").alias("admin1"), F.col("_c14").cast("long").alias("population"))


def geo_countries(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, sep="\t", comment="#", quote="")
    return t.select(F.col("_c0").alias("country_code"), F.col("_c4").alias("country"))


def merge_cities(rows: DataFrame) -> DataFrame:
    """One row a (city, state, country): largest population, union of aliases, remote only if any says so."""
    return rows.groupBy("city", "state", "country").agg(F.max("population").alias("population"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.max("remoteOnly").alias("remoteOnly"))


def bulk_sites(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of an import: an address, then a pattern, a type and a provider in any order."""
    parts = F.transform(F.split(col(column), ","), trim)
    known = [*SITE_TYPES, *PROVIDERS]
    pick = lambda words: F.try_element_at(F.filter(F.slice("p", 2, 9), lambda x: F.lower(x).isin(words)), F.lit(1))
    rest = F.filter(F.slice("p", 2, 9), lambda x: (x != "") & ~F.lower(x).isin(known))
    rows = lines.withColumn("p", parts).where(F.try_element_at("p", F.lit(1)) != "")
    return rows.select(F.col("p")[0].alias("url"), F.try_element_at(rest, F.lit(1)).alias("pattern"), F.coalesce(lower(pick(SITE_TYPES)), F.lit("general")).alias("type"), lower(pick(PROVIDERS)).alias("provider"))


def filter_settings(defaults: dict[str, list[str]], extra: dict[str, list[str]]) -> dict[str, list[str]]:
    """Defaults first, then the file's, lower-cased and distinct in order."""
    merged = {}
    for k in [*defaults, *(k for k in extra if k not in defaults)]:
        merged[k] = list(dict.fromkeys(x.strip().lower() for x in [*defaults.get(k, []), *extra.get(k, [])] if x and x.strip()))
    return merged
