"""From payloads and page texts to typed job rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import clock, company, location, pay, payload, text, url
from harborlight.functions.base import col, lower, squeeze, trim

# Headings under which a posting names its places, and words of an arrangement that is not remote.
PLACE_LABELS = ["location", "locations", "office", "offices", "where you", "based in", "work location"]
ON_SITE = ["hybrid", "onsite", "on-site", "in office", "in-office"]


def extract_jobs(scrapes: DataFrame, now_ms: int, column: str = "payload") -> DataFrame:
    """Typed job rows of JSON payloads: every row of every array, with title, address and pay from any spelling.

    A row without an address goes; a noisy title falls back to the address's, and a row with neither goes.
    """
    row = F.col("row")
    rows = scrapes.withColumn("row", F.explode(payload.payload_rows(payload.variant(column)))).drop(column)
    kept = [c for c in rows.columns if c != "row"]
    # In steps behind generators of one row each: filters on a later step are not rewritten into copies of the earlier ones.
    step = lambda df, name, **fields: df.withColumn(name, F.explode(F.array(F.struct(*(c.alias(k) for k, c in fields.items())))))
    read = rows.select(
        *kept, payload.first_text(row, payload.TITLE_KEYS).alias("_raw"), payload.first_text(row, payload.URL_KEYS).alias("_href"), payload.first_text(row, ["company", "company_name", "employer"]).alias("_firm"),
        F.coalesce(payload.get(row, "$.location.name"), payload.first_text(row, ["location", "location_name", "city"])).alias("_place"), payload.first_text(row, ["level", "seniority"]).alias("_level"),
        payload.first_text(row, ["remote"]).alias("_remote"), payload.pay_range(payload.get(row, "$.salary", "variant")).alias("_range"), payload.number(row, "$.total_compensation").alias("_sum"),
        payload.first_text(row, ["compensation", "salary", "pay"]).alias("_pay"), payload.first_text(row, ["posted_at", "postedAt", "updated_at", "first_published", "date"]).alias("_at"),
    )
    clean = step(read, "_c", title=text.clean_scraped("_raw"), url=url.job_url("_href"))
    title, link = F.col("_c.title"), F.col("_c.url")
    named = step(clean, "_n", title=F.when(~text.is_noisy_title(title), title).otherwise(url.title_from_url(link)), url=link)
    named = named.where("_n.url is not null and _n.title is not null").withColumn("url", F.col("_n.url")).withColumn("_named", F.col("_n.title"))
    paid = step(named, "_p", sum=F.coalesce("_range", "_sum", pay.pay_from_field("_pay")), posted=clock.posted_at("_at", F.lit(now_ms)))
    paid = paid.withColumn("_paid", F.col("_p.sum")).withColumn("_posted", F.col("_p.posted"))
    return paid.select(
        *kept, text.capped_title("_named").alias("title"), "url", F.coalesce(F.col("_firm"), F.nullif(url.company_from_url("url"), F.lit(""))).alias("company"), F.coalesce("_place", F.lit("Unknown")).alias("location"),
        pay.level_at_ingest("_level", "_named").alias("level"), pay.remote_at_store(F.col("_remote"), F.col("_place"), F.col("_named")).alias("remote"),
        F.coalesce("_paid", F.lit(0.0)).alias("totalCompensation"), F.col("_paid").isNull().alias("compensationUnknown"),
        F.col("_posted.ms").alias("postedAt"), F.col("_posted.unknown").alias("postedAtUnknown"), text.engineer_flag("_named").alias("engineer"),
    )


def with_places(jobs: DataFrame) -> DataFrame:
    """Adds the derived place columns of a job: places, states, countries, country, search tokens.

    Every place is read once, behind a generator of one row, so that what derives from it holds no copies of the reading.
    """
    step = lambda df, c: df.withColumn("_p", F.explode(F.array(c)))
    out = step(step(jobs, location.read_places(location.split_places("location"))), location.us_first_read(F.col("_p")))
    p = F.col("_p")
    out = out.withColumn("locations", location.place_names(p)).withColumn("locationStates", location.distinct_known(F.transform(p, lambda r: r["state"])))
    out = out.withColumn("countries", location.distinct_known(F.transform(p, lambda r: r["country"]))).withColumn("locationSearch", location.search_tokens_read(p))
    return out.withColumn("country", location.job_country(F.lit(None).cast("string"), F.col("countries"), F.col("locationStates"))).drop("_p")


def heading_title(c: Column | str) -> Column:
    """The first markdown heading that looks like a title."""
    heads = F.regexp_extract_all(col(c), F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))
    good = F.filter(F.transform(heads, lambda h: trim(squeeze(F.regexp_replace(h, r"[*_`#]", "")))), lambda h: (F.length(h) <= 140) & ~text.is_noisy_title(h) & ~text.sentence_like(h))
    return F.try_element_at(good, F.lit(1))


def labelled_place(c: Column | str) -> Column:
    """What follows a place label on its line."""
    return F.nullif(trim(F.regexp_extract(col(c), r"(?im)^[\s*#-]*(?:" + "|".join(PLACE_LABELS) + r")\s*[:\-]\s*([^\n]{2,100})$", 1)), F.lit(""))


def hints(c: Column | str) -> Column:
    """struct(title, company, level, location, remote, pay, currency) read off a posting's text."""
    t = col(c)
    bar = r"(?m)^#*\s*(.+?)\s+in\s+([^|\n]+?)\s*\|\s*([^|\n]+)$"
    title = F.coalesce(F.nullif(trim(F.regexp_extract(t, bar, 1)), F.lit("")), heading_title(t))
    firm = F.coalesce(F.nullif(trim(F.regexp_extract(t, bar, 3)), F.lit("")), F.nullif(trim(F.regexp_extract(t, r"(?m)^#*\s*About\s+([A-Z][\w&. ]{1,40})$", 1)), F.lit("")))
    spot = location.city_state_in(t)
    place = F.coalesce(F.nullif(trim(F.regexp_extract(t, bar, 2)), F.lit("")), labelled_place(t), F.concat(spot["city"], F.lit(", "), spot["state"]))
    low = lower(t)
    fixed = text.contains_any(low, ON_SITE)
    remote = F.when(fixed, False).when(low.contains("remote") & place.isNull(), True).otherwise(lower(place).contains("remote"))
    hourly = F.regexp_extract(t, r"\$\s*(\d{2,3}(?:\.\d+)?)\s*(?:-|to)?\s*(?:\$?\s*\d{2,3}(?:\.\d+)?)?\s*(?:per hour|/ ?hr|an hour|hourly)", 1)
    paid = F.coalesce(pay.bounded_pay(pay.hint_pay(t)), F.when(hourly != "", pay.hourly_to_annual(hourly.cast("double"))))
    level = F.nullif(F.regexp_extract(lower(title), r"\b(intern|junior|mid|senior|staff|principal|lead|manager|director)\b", 1), F.lit(""))
    return F.struct(title.alias("title"), firm.alias("company"), level.alias("level"), place.alias("location"), F.coalesce(remote, F.lit(False)).alias("remote"), paid.alias("pay"), pay.currency_code(t).alias("currency"))


def patched_by_hints(jobs: DataFrame, column: str = "description") -> DataFrame:
    """Fills only what a job lacks: unknown title or company, level, place, pay."""
    h = F.col("_h")  # one struct, computed once
    better = lambda old, new: F.when(text.is_unknown_label(old) & new.isNotNull(), new).otherwise(F.col(old))
    out = jobs.withColumn("_h", hints(column))
    out = out.withColumn("company", F.when(company.should_override("company") & h["company"].isNotNull(), h["company"]).otherwise(F.col("company")))
    out = out.withColumn("title", F.when(text.is_unknown_title("title") & h["title"].isNotNull(), h["title"]).otherwise(F.col("title"))).withColumn("location", better("location", h["location"]))
    paid = F.when(F.coalesce(F.col("totalCompensation"), F.lit(0.0)) > 0, F.col("totalCompensation")).otherwise(h["pay"].cast("double"))
    return out.withColumn("totalCompensation", paid).withColumn("compensationUnknown", paid.isNull()).drop("_h")


def ordered_patterns(learned: DataFrame, defaults: DataFrame) -> DataFrame:
    """Patterns of each domain and field to try, learned ones by success first, then the defaults."""
    rows = learned.select("domain", "field", "regex", F.lit(0).alias("kind"), (-F.col("successCount")).alias("rank")).union(
        learned.select("domain").distinct().crossJoin(F.broadcast(defaults.select("field", "regex", "rank"))).select("domain", "field", "regex", F.lit(1).alias("kind"), "rank")
    )
    return rows.groupBy("domain", "field").agg(F.transform(F.array_sort(F.collect_set(F.struct("kind", "rank", "regex"))), lambda x: x["regex"]).alias("patterns"))


def cut_banner(c: Column | str) -> Column:
    """Drops lines of cookie notices, empty links and lone tags."""
    lines = F.split(col(c), "\n")
    junk = lambda s: F.lower(s).rlike(r"cookie (policy|settings|preferences)|accept all cookies|we use cookies") | s.rlike(r"^\s*\[\s*\]\([^)]*\)\s*$") | s.rlike(r"^\s*<[^>]+>\s*$")
    return F.array_join(F.filter(lines, lambda s: ~junk(s)), "\n")


def form_key(label: Column | str) -> Column:
    """Which field of a résumé a form label asks for; the first rule that fits."""
    low = lower(col(label))
    rules = [("email", "email|e-mail"), ("phone", "phone|mobile"), ("first_name", "first name|given name"), ("last_name", "last name|surname|family name"), ("linkedin", "linkedin"), ("github", "github"), ("portfolio", "portfolio|website"), ("city", "city|town"), ("state", "state|province"), ("country", "country"), ("postal_code", "zip|postal"), ("address", "address|street"), ("salary", "salary|compensation"), ("start_date", "start date|available"), ("visa", "sponsor|visa|authori[sz]ed"), ("company", "current company|employer"), ("title", "current title|job title"), ("school", "school|university"), ("cover_letter", "cover letter"), ("name", "name")]
    return F.coalesce(*(F.when(low.rlike(r), k) for k, r in rules))
