"""The URL work queue as pure transitions: enqueue, lease, complete, release, purge.

Each takes tables and the clock and returns tables, so that a batch job, a stream's micro-batch and a test run the
same code. States: pending, processing, completed, failed, invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harborlight.functions import url
from harborlight.functions.base import trim
from harborlight.functions.clock import DAY_MS, HOUR_MS, MINUTE_MS
from harborlight.operators.scratch import kept

TERMINAL = ["completed", "failed", "invalid"]
TTL_MS, MOST_ATTEMPTS = 7 * DAY_MS, 3


def due(now_ms: int) -> Column:
    return (F.col("status") == "pending") & (F.coalesce("scheduledAt", F.lit(0)) <= now_ms)


def stale(now_ms: int, ttl_ms: int = TTL_MS) -> Column:
    return (F.coalesce("createdAt", F.lit(0)) < now_ms - ttl_ms) | (F.coalesce("updatedAt", F.col("createdAt"), F.lit(0)) < now_ms - ttl_ms)


def outlived(now_ms: int) -> Column:
    """Past the time to live; a row without a time of creation has no age."""
    return F.coalesce(F.col("createdAt") < now_ms - TTL_MS, F.lit(False))


def spelt(addresses: DataFrame) -> DataFrame:
    """(url, spelling): every spelling of each row's address.

    The spellings are a column of a select before they are rows, where their equal parts are computed once. Give the rows as they are:
    Catalyst folds a select into the aggregation under it, such as a distinct, and parts are not shared there.
    """
    return addresses.select("url", url.url_candidates("url").alias("_s")).select("url", F.explode_outer("_s").alias("spelling")).where("spelling is not null")


def sorted_requests(requests: DataFrame, queue: DataFrame, jobs: DataFrame, ignored: DataFrame, now_ms: int) -> DataFrame:
    """Requests (url, sourceUrl, delay_ms, pos), one an address, with their kind: seen, requeued, inserted or kept.

    Repeats and ignored addresses go; an address any spelling of which is a job is only recorded as seen; a known
    queue row is requeued when it is stale or terminal and kept as it is otherwise; the rest are new.
    What is known of an address meets it in one aggregation; only spellings other than itself are joined.
    """
    rest = [c for c in requests.columns if c != "url"]
    asked = requests.withColumn("url", F.trim("url")).where("url <> ''")
    others = spelt(asked).where("spelling <> url").join(jobs.select(F.col("url").alias("spelling")), "spelling", "left_semi")
    yes = F.lit(True)
    told = [
        ignored.select("url", yes.alias("_ignored")),
        queue.select("url", F.coalesce(F.col("status").isin(TERMINAL) | stale(now_ms), F.lit(False)).alias("_again")),
        jobs.select("url", yes.alias("_alike")),
        others.select("url", yes.alias("_other")),
    ]
    rows = asked.select("url", F.struct(*rest).alias("_r"), "pos", yes.alias("_asked"))
    for t in told:
        rows = rows.unionByName(t, allowMissingColumns=True)
    flags = [F.bool_or(c).alias(c) for c in ("_asked", "_ignored", "_again", "_alike", "_other")]
    one = rows.groupBy("url").agg(F.min_by("_r", "pos").alias("_r"), *flags).where("_asked and _ignored is null")
    seen = F.col("_other") | (F.col("_alike") & (trim("url") == F.col("url")))  # an address in Unicode spaces is none of its spellings
    kind = F.when(seen, "seen").when(F.col("_again"), "requeued").when(F.col("_again").isNull(), "inserted").otherwise("kept")
    return one.select("url", *(F.col(f"_r.{c}").alias(c) for c in rest), kind.alias("kind"))


def enqueue(requests: DataFrame, queue: DataFrame, jobs: DataFrame, ignored: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """The requests of sorted_requests apart: seen ones, and requeued and inserted ones as pending rows without attempts."""
    tagged = sorted_requests(requests, queue, jobs, ignored, now_ms)
    at = F.lit(now_ms) + F.coalesce("delay_ms", F.lit(0))
    of = lambda kind: tagged.where(F.col("kind") == kind).drop("kind")
    pending = lambda df: df.select("url", "sourceUrl", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), at.alias("scheduledAt"))
    return {"seen": of("seen"), "requeued": pending(of("requeued")), "inserted": pending(of("inserted"))}


def release_expired(queue: DataFrame, now_ms: int, expiry_ms: int) -> DataFrame:
    """Processing rows past their lease go back to pending and keep their attempts; a missing time counts as past."""
    expiry = min(max(expiry_ms, MINUTE_MS), DAY_MS)
    past = (F.col("status") == "processing") & (F.coalesce("updatedAt", F.lit(0)) < now_ms - expiry)
    return queue.withColumn("status", F.when(past, "pending").otherwise(F.col("status")))


def round_robin(rows: DataFrame, bucket: str, order: list[str], limit: int) -> DataFrame:
    """One row of each bucket a turn, buckets in the order of their first row, until the limit."""
    turns = rows.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))
    turns = turns.withColumn("lead", F.min(F.struct(*order)).over(W.partitionBy(bucket)))
    return turns.orderBy("turn", "lead").limit(limit).drop("lead")


def lease(queue: DataFrame, now_ms: int, limit: int, expiry_ms: int = 20 * MINUTE_MS) -> dict[str, DataFrame]:
    """Takes due rows fairly over sites: struct of leased rows (now processing, one attempt more) and expired ones."""
    limit = min(max(limit, 1), 200)
    freed = release_expired(queue, now_ms, expiry_ms)
    order = ["attempts", "scheduledAt", "createdAt", "url"]
    ready = freed.where(due(now_ms)).withColumn("bucket", F.coalesce("siteId", "sourceUrl", url.domain_key("url"), "url"))
    expired = ready.where(outlived(now_ms))
    live = ready.where(~outlived(now_ms)).orderBy(*order).limit(3 * limit)
    taken = round_robin(live, "bucket", order, limit)
    taken = taken.withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1).withColumn("updatedAt", F.lit(now_ms))
    return {"leased": taken, "expired": expired.withColumn("status", F.lit("failed"))}


def lease_fit(queue: DataFrame, seen: DataFrame, now_ms: int, limit: int, expiry_ms: int = 20 * MINUTE_MS, rounds: int = 3) -> dict[str, DataFrame]:
    """Leases until a batch holds an address worth fetching: tables leased (at most limit rows) and skipped (url, error), both read from the shared store.

    Of each batch, rows out of attempts, addresses of sign-in pages and those that seen (sourceUrl, url) lists for their site are skipped, for the
    first of these reasons; a batch of nothing else is followed by another, three at most; rows of one address go together. Rows of a blank address
    are leased, but neither kept nor skipped. seen is met by an equality join; a batch has at most 200 rows, so only its emptiness reaches the driver.
    """
    left, batches = queue, []
    listed = seen.select("sourceUrl", "url").distinct().withColumn("_seen", F.lit(True))
    for n in range(rounds):
        taken = lease(left, now_ms, limit, expiry_ms)["leased"].where(F.trim("url") != "").join(listed, ["sourceUrl", "url"], "left")
        why = F.when(F.col("attempts") > MOST_ATTEMPTS, "max_attempts_exceeded").when(url.is_auth_url("url"), "auth_url").when(F.col("_seen"), "skip_listed_url")
        batches.append(kept(taken.withColumn("error", why).drop("_seen"), f"lease-{n}"))
        if batches[-1].isEmpty() or not batches[-1].where("error is null").isEmpty():
            break
        left = left.join(batches[-1].select("url"), "url", "left_anti")
    skipped = batches[0]
    for b in batches[1:]:
        skipped = skipped.unionByName(b)
    return {"leased": batches[-1].where("error is null").drop("error"), "skipped": skipped.where("error is not null").select("url", "error")}


def verdicts(scrapes: DataFrame) -> DataFrame:
    """(url, new_status, error) for complete(): scrapes (subUrls, sourceUrl, outcome) settle their first address that isn't blank, else their source.

    An outcome stored completes it, invalid_scrape makes it invalid, another or none fails it. Of several scrapes of one address the worst counts:
    failed before invalid before completed. Scrapes without an address settle nothing.
    """
    first = F.get(F.filter("subUrls", lambda u: F.coalesce(F.trim(u), F.lit("")) != ""), 0)
    each = scrapes.select(F.coalesce(first, F.nullif(F.trim("sourceUrl"), F.lit(""))).alias("url"), F.when(F.col("outcome") == "stored", 0).when(F.col("outcome") == "invalid_scrape", 1).otherwise(2).alias("rank"))
    worst = each.where("url is not null").groupBy("url").agg(F.max("rank").alias("rank"))
    status = F.when(F.col("rank") == 0, "completed").when(F.col("rank") == 1, "invalid").otherwise("failed")
    return worst.select("url", status.alias("new_status"), F.when(F.col("rank") == 1, "invalid_job_data").when(F.col("rank") == 2, "store_scrape_failed").alias("error"))


def complete(queue: DataFrame, results: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """results (url, new_status, error): a failed row out of attempts or not found moves to ignored, others change state."""
    r = results.groupBy("url").agg(F.max("new_status").alias("new_status"), F.max("error").alias("error"))
    both = queue.join(r, "url", "left")
    gone = (F.col("new_status") == "failed") & ((F.col("attempts") >= MOST_ATTEMPTS) | F.coalesce(F.col("error").contains("404"), F.lit(False)))
    gone = F.coalesce(gone, F.lit(False))
    reason = F.when(F.col("error").contains("404"), "http_404").otherwise("max_attempts")
    kept = both.where(~gone).withColumn("status", F.coalesce("new_status", "status"))
    kept = kept.withColumn("completedAt", F.when(F.col("new_status") == "completed", F.lit(now_ms)).otherwise(F.col("completedAt")) if "completedAt" in queue.columns else F.when(F.col("new_status") == "completed", F.lit(now_ms)))
    return {"queue": kept, "ignored": both.where(gone).select("url", reason.alias("reason"))}


def purge(queue: DataFrame, now_ms: int) -> DataFrame:
    """Pending and processing rows older than the time to live go."""
    return queue.where(~(F.coalesce(F.col("status").isin("pending", "processing"), F.lit(False)) & outlived(now_ms)))


def stagger(rows: DataFrame, is_listing: Column, order: list[Column], step_ms: int = 30_000) -> DataFrame:
    """Listing pages wait a step more each; other addresses none."""
    n = F.row_number().over(W.partitionBy("sourceUrl", "_l").orderBy(*order)) - 1
    return rows.withColumn("_l", is_listing).withColumn("delay_ms", F.when(F.col("_l"), n * step_ms).otherwise(0)).drop("_l")


def hourly(ms: Column) -> Column:
    return F.floor(ms / HOUR_MS).cast("long")
