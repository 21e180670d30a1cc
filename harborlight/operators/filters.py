"""Row filters of the job search and of the ingest gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import company, location, text, url
from harborlight.functions.base import all_of, truthy


def job_filter(remote: bool | None = None, engineer: bool | None = None, hide_unknown: bool = False, least: float | None = None, most: float | None = None, state: str = "", country: str = "", companies: list[str] | None = None) -> Column:
    """Conjunction of the search's filters; unknown pay passes both bounds but not hide_unknown."""
    unknown = truthy("compensationUnknown") | ~F.coalesce(F.col("totalCompensation") > 0, F.lit(False))
    tests = [F.lit(True)]
    if remote is not None:
        tests.append(truthy("remote") == remote)
    if engineer:
        tests.append(truthy("engineer"))
    if hide_unknown:
        tests.append(~unknown)
    if least is not None:
        tests.append(unknown | (F.col("totalCompensation") >= least))
    if most is not None:
        tests.append(unknown | (F.col("totalCompensation") <= most))
    if state:
        tests.append(F.array_contains("locationStates", state))
    if country:
        tests.append(location.matches_country(F.col("country"), country))
    if companies:
        tests.append(company.filter_key("company").isin(companies))
    return all_of(*tests)


def passes_gate(title: str, place: str, keywords: list[str], non_us: list[str], cities: list[str]) -> Column:
    """Ingest gate: title keyword and a place in the US or unknown."""
    return text.has_required_keyword(title, keywords) & location.matches_usa(place, non_us, cities)


def seed_listings(jobs: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows kept and dropped: a row goes if its address is a seed's and it looks like a listing."""
    keys = seeds.select(url.url_key("seed_url").alias("seed_key")).distinct()
    marked = jobs.withColumn("_key", url.url_key("url")).join(keys, F.col("_key") == F.col("seed_key"), "left")
    listing = F.col("seed_key").isNotNull() & (url.is_listing_url("url") | text.is_listing_text("title", "description"))
    marked = marked.withColumn("_listing", F.coalesce(listing, F.lit(False)))
    return marked.where(~F.col("_listing")).drop("_key", "seed_key", "_listing"), marked.where("_listing").select("url", "title")


def needs_details(now_ms: int, version: int = 4, tries: int = 3, retry_ms: int = 86_400_000) -> Column:
    """A job still waits for its details: pending or without pay, and tries, time or version allow another attempt."""
    waiting = (F.col("compensationReason") == "pending") | (truthy("compensationUnknown") & (F.coalesce("totalCompensation", F.lit(0)) == 0))
    again = (F.coalesce("heuristicAttempts", F.lit(0)) < tries) | (F.coalesce("heuristicLastTried", F.lit(0)) < now_ms - retry_ms) | (F.coalesce("heuristicVersion", F.lit(0)) < version)
    return F.coalesce(waiting & again, F.lit(False))
