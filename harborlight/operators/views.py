"""Lists and lookups of the back office: newest rows, site lists, logs joined to jobs, company names, saved filters.

Every list with a limit is a top-k; lookups are equality joins; a latest row of a key is an aggregate, not a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harborlight.functions import company


def newest(rows: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The rows of the latest times, ties by key; the limit is held to 1..200."""
    return rows.orderBy(F.desc_nulls_last(by), key).limit(min(max(limit, 1), 200))


def successful_sites(sites: DataFrame, limit: int) -> DataFrame:
    return newest(sites.where("completed"), "lastRunAt", "siteId", limit)


def failed_sites(sites: DataFrame, limit: int) -> DataFrame:
    """Failed and not completed since."""
    return newest(sites.where(F.coalesce("failed", F.lit(False)) & ~F.coalesce("completed", F.lit(False))), "lastFailureAt", "siteId", limit)


def by_source(scrapes: DataFrame, limit: int) -> DataFrame:
    """Scrapes in descending order of their source's address, latest first."""
    return scrapes.orderBy(F.desc("sourceUrl"), F.desc("createdAt"), "url").limit(limit)


def pending_events(events: DataFrame, kind: str | None, before: int | None, limit: int) -> DataFrame:
    """Unprocessed webhook events of a kind that came before a time, oldest first."""
    test = ~F.coalesce("processed", F.lit(False))
    test = test & (F.col("event") == kind) if kind else test
    test = test & (F.col("receivedAt") < before) if before is not None else test
    return events.where(test).orderBy("receivedAt", "id").limit(limit)


def next_in_line(queue: DataFrame) -> DataFrame:
    """The oldest pending row, or none."""
    return queue.where("status = 'pending'").orderBy("queuedAt", "id").limit(1)


def latest_of(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """A worker's or any key's latest row: a point lookup on the aggregate."""
    return rows.where(F.col(key) == value).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(by, *[c for c in rows.columns if c not in (key, by)])).alias("row")).select(key, "row.*")


def history(rows: DataFrame, urls: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The latest rows of each asked address (url, pos), in the order that they were asked."""
    asked = urls.groupBy("url").agg(F.min("pos").alias("pos"))
    ranked = rows.join(asked, "url").withColumn("rank", F.row_number().over(W.partitionBy("url").orderBy(F.desc(by), key)))
    return ranked.where(F.col("rank") <= limit)


def with_alias(requests: DataFrame, sites: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests with their site's name and the company of the site's domain, either null where unknown."""
    return requests.join(sites.select("siteId", "name", "domain"), "siteId", "left").join(aliases.select("domain", F.col("alias").alias("company")), "domain", "left")


def job_details(jobs: DataFrame, details: DataFrame, applications: DataFrame) -> DataFrame:
    """Jobs with their details, whose columns win over the job's own, and the number of users that applied."""
    shared = [c for c in details.columns if c in jobs.columns and c != "_id"]
    extra = [c for c in details.columns if c not in jobs.columns]
    d = details.select("_id", *(F.col(c).alias(f"_d_{c}") for c in shared), *extra)
    applied = applications.where("status = 'applied'").groupBy(F.col("jobId").alias("_id")).agg(F.countDistinct("userId").alias("applied"))
    both = jobs.join(d, "_id", "left").join(applied, "_id", "left")
    columns = [F.coalesce(f"_d_{c}", c).alias(c) if c in shared else F.col(c) for c in jobs.columns]
    return both.select(*columns, *extra, F.coalesce("applied", F.lit(0)).alias("applied"))


def url_logs(scrapes: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for each address of each scrape (scrapeId, urls, at), with the job of that address, slashes at its end aside."""
    each = scrapes.select("scrapeId", "at", F.explode("urls").alias("url")).withColumn("_key", F.rtrim(F.col("url"), F.lit("/")))
    known = jobs.groupBy(F.rtrim(F.col("url"), F.lit("/")).alias("_key")).agg(F.min("_id").alias("jobId"))
    return each.join(known, "_key", "left").drop("_key")


def scrape_log(scrapes: DataFrame, jobs: DataFrame) -> DataFrame:
    """What became of each address of each scrape: scrapes (scrapeId, sourceUrl, at, rows, links) give scrapeId, at, url, reason, action, jobId and
    the two counts.

    rows are the addresses of normalised rows, null or blank where a row has none; without rows, links are the raw addresses found; without both,
    the scrape itself is one entry. A row is missing_url without an address, else already_saved if a job has it; a link is listing_only; an empty
    scrape is no_items, or no_items_existing_job. Entries with one of these reasons but missing_url, and those whose address a job has, are skipped,
    others scraped. Addresses meet jobs whatever their slashes at the end; of a job's repeats the least id counts.
    """
    n, raw = (F.coalesce(F.size(c), F.lit(0)) for c in ("rows", "links"))
    entry = lambda u, why: F.struct(u.alias("url"), why.alias("reason"))
    blank = lambda u: F.coalesce(F.trim(u), F.lit("")) == ""
    of_rows = F.transform("rows", lambda u: entry(u, F.when(blank(u), "missing_url")))
    of_links = F.transform("links", lambda u: entry(u, F.lit("listing_only")))
    entries = F.when(n > 0, of_rows).when(raw > 0, of_links).otherwise(F.array(entry(F.col("sourceUrl"), F.lit("no_items"))))
    each = scrapes.select("scrapeId", "at", "sourceUrl", n.alias("rowCount"), raw.alias("linkCount"), F.explode(entries).alias("e"))
    address = F.coalesce(F.when(blank(F.col("e.url")), F.col("sourceUrl")).otherwise(F.trim("e.url")), F.lit("unknown"))
    each = each.select("*", address.alias("url"), F.col("e.reason").alias("why")).withColumn("_key", F.rtrim(F.col("url"), F.lit("/")))
    known = jobs.where("url is not null").groupBy(F.rtrim(F.trim("url"), F.lit("/")).alias("_key")).agg(F.min("_id").alias("jobId"))
    met = each.join(known, "_key", "left")
    saved = F.col("jobId").isNotNull()
    reason = F.when((F.col("why") == "no_items") & saved, "no_items_existing_job").otherwise(F.coalesce("why", F.when(saved, "already_saved")))
    skipped = saved | F.coalesce(reason != "missing_url", F.lit(False))
    return met.select("scrapeId", "at", "url", reason.alias("reason"), F.when(skipped, "skipped").otherwise("scraped").alias("action"), "jobId", "rowCount", "linkCount")


def company_names(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(input, resolved, names): the profile whose name, else whose alias is the input, and all its names.

    profiles (name, aliases); of several profiles a name's outranks an alias's, then the least name.
    """
    name = profiles.select("name", F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("names"))
    keyed = name.select("name", "names", F.posexplode("names").alias("at", "spelt"))
    keyed = keyed.select("name", "names", company.filter_key("spelt").alias("key"), F.least("at", F.lit(1)).alias("rank"))
    best = keyed.groupBy("key").agg(F.min_by(F.struct("name", "names"), F.struct("rank", "name")).alias("p"))
    asked = wanted.select("input", company.filter_key("input").alias("key"))
    found = asked.join(best, "key", "left")
    return found.select("input", F.coalesce("p.name", "input").alias("resolved"), F.coalesce(F.array_distinct(F.col("p.names")), F.array("input")).alias("names"))


def retagged(jobs: DataFrame, aliases: DataFrame, host: Column, applies: Column) -> DataFrame:
    """Jobs of some hosts take the company of their host's alias; only the changed rows, with the old name."""
    a = aliases.groupBy(F.col("domain").alias("_host")).agg(F.min("alias").alias("alias"))
    met = jobs.where(applies).withColumn("_host", host).join(a, "_host")
    return met.where(~F.col("company").eqNullSafe(F.col("alias"))).select("_id", F.col("company").alias("was"), F.col("alias").alias("company"))


def filled_companies(ignored: DataFrame, aliases: DataFrame, host: Column, derived: Column) -> DataFrame:
    """Rows without a company take their host's alias, else the name derived from the address."""
    a = aliases.groupBy(F.col("domain").alias("_host")).agg(F.min("alias").alias("alias"))
    out = ignored.withColumn("_host", host).join(a, "_host", "left")
    return out.withColumn("company", F.coalesce(F.nullif("company", F.lit("")), "alias", derived)).drop("_host", "alias")


def ignored_groups(ignored: DataFrame) -> DataFrame:
    """(company, n, latest): groups of ignored rows, latest first."""
    return ignored.groupBy("company").agg(F.count("*").alias("n"), F.max("createdAt").alias("latest")).orderBy(F.desc("latest"), "company")


def schedule_summary(sites: DataFrame, now_ms: int) -> DataFrame:
    """Number of sites and the least id by state: failed, locked, due, not_due or unscheduled."""
    state = (
        F.when(F.coalesce("failed", F.lit(False)), "failed")
        .when(F.coalesce(F.col("lockedUntil") > now_ms, F.lit(False)), "locked")
        .when(F.col("nextRunAt").isNull(), "unscheduled")
        .when(F.col("nextRunAt") <= now_ms, "due")
        .otherwise("not_due")
    )
    return sites.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("siteId").alias("sample"))


def schedule_audit(verdicts: DataFrame) -> DataFrame:
    """The verdict rows (siteId, verdict) and one row of totals behind them."""
    total = verdicts.agg(F.count("*").alias("sites"), F.count_if(F.col("verdict") == "due").alias("due"), F.count_if(F.col("verdict") != "due").alias("skipped"))
    rows = verdicts.select(F.lit("site").alias("kind"), "siteId", "verdict", *(F.lit(None).cast("long").alias(c) for c in ("sites", "due", "skipped")))
    return rows.unionByName(total.select(F.lit("summary").alias("kind"), "*"), allowMissingColumns=True)


def only_live(live: DataFrame, seen: DataFrame, key: Column) -> DataFrame:
    """Addresses of a live listing that were never seen."""
    return live.withColumn("_key", key).join(seen.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def counted_patterns(stored: DataFrame, hits: DataFrame) -> DataFrame:
    """Success counts of learned patterns after some hits (domain, field, regex, at): additive, with the latest time."""
    add = hits.groupBy("domain", "field", "regex").agg(F.count("*").alias("successCount"), F.max("at").alias("lastSuccessAt"))
    both = stored.select("domain", "field", "regex", "successCount", "lastSuccessAt").unionByName(add)
    return both.groupBy("domain", "field", "regex").agg(F.sum("successCount").alias("successCount"), F.max("lastSuccessAt").alias("lastSuccessAt"))


def save_filter(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Saved filters (id, userId, name, createdAt, selected) with new ones, each now its user's only selected one."""
    users = new.select("userId").distinct().withColumn("_new", F.lit(True))
    kept = stored.join(users, "userId", "left").withColumn("selected", F.col("selected") & F.col("_new").isNull()).drop("_new")
    last = F.row_number().over(W.partitionBy("userId").orderBy(F.desc("createdAt"), F.desc("id"))) == 1
    return kept.unionByName(new.withColumn("selected", last))


def select_filter(stored: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (userId, filterId; null: none): a user's own filter becomes the only selected one; a foreign id changes nothing."""
    own = chosen.join(stored.select("userId", F.col("id").alias("filterId")), ["userId", "filterId"], "left_semi").union(chosen.where("filterId is null").select("userId", "filterId"))
    own = own.groupBy("userId").agg(F.max("filterId").alias("_to")).withColumn("_asked", F.lit(True))
    return stored.join(own, "userId", "left").withColumn("selected", F.when(F.col("_asked"), F.col("id").eqNullSafe(F.col("_to"))).otherwise(F.col("selected"))).drop("_to", "_asked")


def default_filters(stored: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """Users without a filter get a default one; where none is selected the newest is."""
    missing = users.select("userId").distinct().join(stored.select("userId").distinct(), "userId", "left_anti")
    made = missing.select(F.concat(F.lit("default-"), F.col("userId").cast("string")).alias("id"), "userId", F.lit("Default").alias("name"), F.lit(now_ms).alias("createdAt"), F.lit(True).alias("selected"))
    state = stored.groupBy("userId").agg(F.bool_or("selected").alias("_any"), F.max_by("id", F.struct("createdAt", "id")).alias("_newest"))
    kept = stored.join(state, "userId").withColumn("selected", F.col("selected") | (~F.col("_any") & (F.col("id") == F.col("_newest")))).drop("_any", "_newest")
    return kept.unionByName(made)


def window_reset(tables: dict[str, tuple[DataFrame, str]], lo: int, hi: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without their rows of a window of time (lo to hi, the end left out), and how many rows of each went."""
    inside = lambda c: F.coalesce((F.col(c) >= lo) & (F.col(c) < hi), F.lit(False))
    kept = {n: df.where(~inside(c)) for n, (df, c) in tables.items()}
    counts = [df.where(inside(c)).agg(F.count("*").alias("deleted")).select(F.lit(n).alias("name"), "deleted") for n, (df, c) in tables.items()]
    out = counts[0]
    for x in counts[1:]:
        out = out.union(x)
    return kept, out
