"""Derived fields of postings: addresses, titles, pay, places, company names and salvaged JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import NOW_MS, oracle, shape
from harborlight.functions import clock, company, location, pay, payload, text, url
from harborlight.operators import extract, filters, ingest
from harborlight.plans.registry import Registry

R = Registry()
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
#: All white space of Unicode for a pattern of DuckDB.
_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


def _words(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _squeezed(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


@R.add("page_url_repairs", f"""
SELECT page_id, url AS repaired, url <> '' AS is_link, NOT regexp_matches({_PATH}, '\\d') AND list_contains(['jobs', 'careers', 'career', 'positions', 'openings'], lower(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1])) AS root,
  url || '/careers' AS root_url, NOT regexp_matches({_PATH}, '\\d') AND strpos(url, '?') = 0 AND strpos(url, '#') = 0 AS root_below FROM pages""")  # fmt: skip
def page_url_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses wrapped in signs and with a broken scheme, mended; listing roots told from postings."""
    broken = F.concat(F.lit("<("), F.replace(F.col("url"), F.lit("://"), F.lit(":/")), F.lit(")>"))
    below = F.concat(F.col("url"), F.lit("/careers"))
    return _table(spark, sf_dir, "pages").select(
        "page_id", url.fix_scheme(url.unwrap(broken)).alias("repaired"), url.is_link("url").alias("is_link"), url.is_listing_root("url").alias("root"), below.alias("root_url"), url.is_listing_root(below).alias("root_below")
    )


_PARAM = "regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_append(list_filter(string_split(regexp_extract(url, '^[^?#]*\\??([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, '{n}=')), '{n}=' || {v}), '&')"


@R.add("page_fan_out", f"""
SELECT page_id, 'page' AS kind, {_PARAM.format(n='page', v='p')} AS next FROM (SELECT page_id, url, unnest(range(0, CAST(ceil(length(html) / 500) AS BIGINT))) AS p FROM pages) WHERE p <> page_id % 3
UNION ALL SELECT page_id, 'offset', {_PARAM.format(n='from', v='o')} FROM (SELECT page_id, url, html, 100 * unnest(range(1, 11)) AS o FROM pages) WHERE o < length(html)""")  # fmt: skip
def page_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other pages and the next offsets of each address, its length of text as the total."""
    p = _table(spark, sf_dir, "pages")
    n = F.length("html")
    pages = url.page_urls("url", "page", (F.col("page_id") % 3).cast("int"), F.lit(500), n)
    offsets = url.offset_urls("url", "from", F.lit(0), F.lit(100), n)
    one = lambda kind, urls: p.select("page_id", F.lit(kind).alias("kind"), F.explode(urls).alias("next"))
    return one("page", pages).union(one("offset", offsets))


@R.add("page_apply_urls", """
SELECT page_id, CASE WHEN h IN ('boards-api.greenhouse.io', 'api.greenhouse.io') THEN board WHEN strpos(url, '.example.com') > 0 THEN api ELSE url END AS apply_url FROM (
  SELECT *, CASE WHEN strpos(url, '.example.com') > 0 THEN 'boards-api.greenhouse.io' ELSE 'none' END AS h, 'https://boards.greenhouse.io/x/jobs/' || page_id AS board, 'https://boards-api.greenhouse.io/v1/boards/x/jobs/' || page_id AS api FROM pages)""")  # fmt: skip
def page_apply_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a page's addresses to apply at: its own where it isn't of example.com, else the hosted board's before the board's API."""
    at = lambda head: F.concat(F.lit(head), F.col("page_id").cast("string"))
    own = F.when(~F.col("url").contains(".example.com"), F.col("url"))
    found = F.array(F.lit(" "), at("https://boards-api.greenhouse.io/v1/boards/x/jobs/"), at("https://boards.greenhouse.io/x/jobs/"), own)
    return _table(spark, sf_dir, "pages").select("page_id", url.best_apply_url(found).alias("apply_url"))


_BODY = "regexp_replace(text, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'g')"
for _name, _char in (("<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    _BODY = f"regexp_replace({_BODY}, '{_name}', '{_char}', 'gi')"


@R.add("document_titles", f"""
SELECT doc_id, CASE WHEN t = '' THEN 'Untitled' WHEN length(t) > 140 THEN regexp_replace(substr(t, 1, 137), ' +$', '') || '...' ELSE t END AS title,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '... (+' || (length(text) - 200) || ' chars)' END AS short, CASE WHEN length(text) <= 8 THEN '***' ELSE substr(text, 1, 4) || '...' || substr(text, -4) END AS masked
FROM (SELECT doc_id, text, coalesce({_squeezed(_BODY)}, '') AS t FROM documents)""")  # fmt: skip
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as titles, escaped, cut for a log, and masked."""
    return _table(spark, sf_dir, "documents").select(
        "doc_id", text.normal_title("text").alias("title"), text.escape_html("text").alias("escaped"), text.shrink("text", 200).alias("short"), text.mask_secret("text").alias("masked")
    )


@R.add("listing_texts", """
SELECT conv_id, turn, regexp_matches(lower(t), 'job openings|jobs at|careers at|all locations|all teams|view openings|open positions|open roles') AS listing FROM (
  SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'All Teams ' WHEN 1 THEN 'Open ' ELSE 'roles ' END || text AS t FROM conversations)""")  # fmt: skip
def listing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under headings, one in three of them a listing's."""
    head = F.when(F.col("turn") % 3 == 0, "All Teams").when(F.col("turn") % 3 == 1, "Open").otherwise("roles")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_listing_text(head, "text").alias("listing"))


_NUMBERS = r"list_transform(regexp_extract_all(replace({t}, chr(160), ' '), '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: CASE WHEN length(split_part(replace(x, ',', ''), '.', 1)) <= 15 AND length(split_part(x, '.', 2)) <= 6 THEN CAST(replace(x, ',', '') AS DOUBLE) END)"


@R.add("document_pay", f"""
SELECT doc_id, CASE WHEN floor(m) > 30000 AND floor(m) < 5000000 THEN CAST(floor(m) AS BIGINT) ELSE 0 END AS pay FROM (
  SELECT doc_id, list_max({_NUMBERS.format(t="regexp_replace(text || ' 401(k), ' || (n_chars * 37) || ' a year', '(?i)\\b40[13]\\s*\\(?[kb]\\)?', ' ', 'g')")}) AS m FROM documents)""")  # fmt: skip
def document_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest plausible number of each whole text, a stated sum at its end included and its retirement plan left out."""
    stated = F.concat("text", F.lit(" 401(k), "), (F.col("n_chars") * 37).cast("string"), F.lit(" a year"))
    return _table(spark, sf_dir, "documents").select("doc_id", pay.pay_from_text(stated).alias("pay"))


_BOUND = "CASE WHEN floor({v}) > 30000 AND floor({v}) < 5000000 THEN CAST(floor({v}) AS BIGINT) END"


@R.add("job_pay_inputs", oracle(f"""
SELECT _id, coalesce(CAST(floor((a + b) / 2) AS BIGINT), a, b) AS midpoint, CASE WHEN userId % 3 = 0 THEN k * 1000 WHEN userId % 3 = 1 THEN least(k * 10000, 1000000) END AS typed FROM (
  SELECT *, {_BOUND.format(v='(totalCompensation / 4)')} AS a, {_BOUND.format(v='totalCompensation')} AS b, CAST(floor(totalCompensation / 1000) AS BIGINT) AS k FROM jobs)""", "jobs"))  # fmt: skip
def job_pay_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midpoints of two bounds, and sums as typed into a form."""
    k = F.floor(F.col("totalCompensation") / 1000).cast("long")
    typed = F.when(F.col("userId") % 3 == 0, F.concat(F.lit("$ "), k.cast("string"), F.lit("K"))).when(F.col("userId") % 3 == 1, F.concat((k * 10).cast("string"), F.lit(",000"))).otherwise("about 100k")
    return shape(spark, sf_dir, "jobs").select("_id", pay.midpoint(F.col("totalCompensation") / 4, F.col("totalCompensation")).alias("midpoint"), pay.parse_pay_input(typed).alias("typed"))


@R.add("job_remote_flags", oracle("""
SELECT _id, CASE WHEN remote AND userId % 2 = 0 THEN true WHEN location = 'Remote' THEN true WHEN lower(location) <> 'unknown' THEN false ELSE contains(lower(title), 'remote') END AS remote FROM jobs""", "jobs"))
def job_remote_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("remote") & (F.col("userId") % 2 == 0), "Fully Remote").otherwise("no")
    return shape(spark, sf_dir, "jobs").select("_id", pay.remote_at_ingest(said, F.col("location"), F.col("title")).alias("remote"))


@R.add("company_ingest_names", oracle(f"""
SELECT _id, name, generic, name <> '' AND name IN ('building france', 'machinery india', 'automobile china') AS remote FROM (SELECT _id, lower(trim(company)) IN ('', 'unknown', 'job board', 'jobs', 'careers', 'greenhouse', 'ashby', 'workday') AS generic,
  regexp_replace(trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')), '( ({"|".join(company.INGEST_SUFFIXES)}))+$', '') AS name FROM jobs)""", "jobs"))  # fmt: skip
def company_ingest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "jobs").select(
        "_id", company.ingest_name("company").alias("name"), company.is_generic("company").alias("generic"), company.is_remote_company("company", ["building france", "machinery india", "automobile china"]).alias("remote")
    )


_ABBR = list(location.STATES)
_LANDS = [*location.COUNTRIES, "Atlantis", "Ontario", "texas"]
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_STATES = f"abbr(code, state) AS (VALUES {_values(location.STATES)})"
#: The place that each customer gives, as text: country, state, arrangement and lists of them.
_ADDRESS = f"""CASE c_custkey % 7 WHEN 0 THEN land WHEN 1 THEN initcap_segment || ', ' || list_code WHEN 2 THEN 'Remote - ' || land WHEN 3 THEN land || '; ' || initcap_segment || ',  ' || list_code || ' / Remote'
 WHEN 4 THEN initcap_segment || ', ' || land || ' | Oslo, Norway | ' || initcap_segment || ', Ontario' WHEN 5 THEN 'n/a' ELSE initcap_segment || ' (HQ), ' || land || ', USA;x' END"""
_ADDRESSES = f"""addresses AS (SELECT c_custkey, land, list_code, initcap_segment, {_ADDRESS} AS location FROM (
  SELECT *, [{_words(_ABBR)}][c_custkey % {len(_ABBR)} + 1] AS list_code, [{_words(_LANDS)}][(c_custkey + n_nationkey) % {len(_LANDS)} + 1] AS land, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS initcap_segment FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    code = F.get(F.array(*map(F.lit, _ABBR)), (F.col("c_custkey") % len(_ABBR)).cast("int"))
    segment = F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.expr("substr(c_mktsegment, 2)")))
    land = F.get(F.array(*map(F.lit, _LANDS)), ((F.col("c_custkey") + F.col("n_nationkey")) % len(_LANDS)).cast("int"))
    rows = rows.withColumn("list_code", code).withColumn("land", land).withColumn("initcap_segment", segment)
    return rows.select("c_custkey", "land", "list_code", "initcap_segment", F.expr(_ADDRESS).alias("location"))


_PLACES = rf"""
places AS (SELECT c_custkey, i, place FROM (SELECT c_custkey, unnest(ps) AS place, generate_subscripts(ps, 1) AS i FROM (
  SELECT c_custkey, list_transform(string_split_regex(location, '[;|/]'), lambda p: regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g')), '^[,;]+|[,;]+$', '', 'g')) AS ps FROM addresses)) WHERE length(place) BETWEEN 2 AND 100),
firsts AS (SELECT c_custkey, place, min(i) AS i FROM places GROUP BY ALL),
country(k, country) AS (VALUES {_values(location.COUNTRIES)}),
{_STATES},
parts AS (SELECT c_custkey, place, j, trim(part) AS part, {_KEY.format(t='part')} AS k FROM (SELECT c_custkey, place, unnest(string_split(place, ',')) AS part, generate_subscripts(string_split(place, ','), 1) AS j FROM firsts)),
read AS (SELECT c_custkey, place, j, coalesce(s.state, t.state) AS state,
  coalesce(c.country, CASE WHEN upper(part) IN ({_words(location.PROVINCE_CODES)}) OR parts.k IN ({_words(location.PROVINCES)}) THEN 'Canada' END, CASE WHEN s.state IS NOT NULL OR t.state IS NOT NULL THEN 'United States' END) AS country
  FROM parts LEFT JOIN country c ON c.k = parts.k LEFT JOIN abbr s ON s.code = upper(replace(parts.k, ' ', '')) LEFT JOIN abbr t ON lower(t.state) = parts.k),
named AS (SELECT c_custkey, place, arg_min(country, j) FILTER (country IS NOT NULL) AS first_country, max(state) FILTER (j = 2) AS state FROM read GROUP BY ALL),
told AS (SELECT f.c_custkey, f.place, f.i, n.state, CASE WHEN key = '' THEN NULL WHEN contains(key, 'remote') OR contains(key, 'unknown') OR key IN ('n a', 'na', 'unspecified', 'not available') THEN 'United States' ELSE coalesce(n.first_country, c.country) END AS country
  FROM (SELECT *, {_KEY.format(t='place')} AS key FROM firsts) f JOIN named n USING (c_custkey, place) LEFT JOIN country c ON c.k = f.key),
heads AS (SELECT c_custkey, coalesce(arg_min(place, i) FILTER (country = 'United States' AND NOT contains(lower(place), 'remote') AND lower(place) NOT IN ('unknown', 'n/a', 'n a', 'na', 'unspecified', 'not available')), arg_min(place, i) FILTER (contains(lower(place), 'remote'))) AS head FROM told GROUP BY ALL),
ranked AS (SELECT t.*, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN place = head THEN 0 ELSE 1 END, i) AS pos FROM told t JOIN heads USING (c_custkey)),
tokens AS (SELECT c_custkey, token, min((pos, t_at)) AS place FROM (SELECT c_custkey, pos, unnest(ts) AS token, generate_subscripts(ts, 1) AS t_at FROM (SELECT c_custkey, pos, string_split_regex(concat_ws(' ', place, country), '[\s,]+') AS ts FROM ranked)) WHERE token <> '' GROUP BY ALL),
found AS (SELECT c_custkey, string_agg(place, '; ' ORDER BY pos) AS locations FROM ranked GROUP BY ALL),
states AS (SELECT c_custkey, string_agg(state, '; ' ORDER BY pos) AS states FROM (SELECT c_custkey, state, min(pos) AS pos FROM ranked WHERE state IS NOT NULL GROUP BY ALL) GROUP BY ALL),
lands AS (SELECT c_custkey, string_agg(country, '; ' ORDER BY pos) AS countries, arg_min(country, pos) AS first_one FROM (SELECT c_custkey, country, min(pos) AS pos FROM ranked WHERE country IS NOT NULL GROUP BY ALL) GROUP BY ALL),
searched AS (SELECT c_custkey, string_agg(token, ' ' ORDER BY place) AS search FROM tokens GROUP BY ALL)
"""


@R.add("customer_places", f"""
WITH {_ADDRESSES}, {_PLACES}
SELECT a.c_custkey, coalesce(locations, '') AS locations, coalesce(states, '') AS states, coalesce(countries, '') AS countries, coalesce(search, '') AS search, coalesce(first_one, CASE WHEN states IS NOT NULL THEN 'United States' END, 'Unknown') AS country
FROM addresses a LEFT JOIN found USING (c_custkey) LEFT JOIN states USING (c_custkey) LEFT JOIN lands USING (c_custkey) LEFT JOIN searched USING (c_custkey)""")  # fmt: skip
def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, states, countries, search words and country of every customer's place field."""
    out = extract.with_places(_addresses(spark, sf_dir).select("c_custkey", "location"))
    flat = lambda c: F.array_join(c, "; ").alias
    return out.select("c_custkey", flat("locations")("locations"), flat("locationStates")("states"), flat("countries")("countries"), F.col("locationSearch").alias("search"), "country")


_ACCENTS = "'áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ', 'aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN'"


@R.add("document_folded_keys", f"SELECT doc_id, {_KEY.format(t=f'translate(text, {_ACCENTS})')} AS key, contains(' ' || {_KEY.format(t=f'translate(text, {_ACCENTS})')} || ' ', ' ' || coalesce(lang, '') || ' ') AS names_lang FROM documents")
def document_folded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as keys without accents, and whether a text names its language's code as a word."""
    key = location.folded_key("text")
    return _table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), text.phrase_in(key, F.coalesce("lang", F.lit(""))).alias("names_lang"))


@R.add("customer_place_labels", f"""
WITH {_ADDRESSES}, {_STATES}
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN initcap_segment || ', ' || CASE WHEN land IN ('united states', 'usa', 'us', 'united states of america') THEN list_code ELSE state END WHEN 1 THEN initcap_segment || ', ' || land WHEN 2 THEN 'Remote' ELSE 'Unknown, ' || land END AS label, lower(trim(location)) IN ('', 'unknown', 'n/a', 'n a', 'na', 'unspecified', 'not available') AS unknown FROM addresses JOIN abbr ON code = list_code""")  # fmt: skip
def customer_place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("c_custkey") % 4
    city = F.when(turn <= 1, F.col("initcap_segment")).when(turn == 2, "REMOTE").otherwise("Unknown")
    state = F.when(turn == 1, "Unknown").otherwise(location.state_name("list_code"))
    return _addresses(spark, sf_dir).select("c_custkey", location.short_label(city, state, F.col("land")).alias("label"), location.is_unknown_place("location").alias("unknown"))


_US = "regexp_matches(up, '\\bU\\.S\\.') OR regexp_matches(low, '\\b\\d{5}(-\\d{4})?\\b') OR regexp_matches(up, '(^|[^A-Z])(" + "|".join([*_ABBR, "PR", "GU", "VI"]) + ")([^A-Z]|$)') OR regexp_matches(low, '" + "|".join(s.lower() for s in location.STATES.values()) + "')"
_TERMS = "|".join(t.replace(".", "\\.") for t in location.US_TERMS)


@R.add("customer_gate", f"""
WITH {_ADDRESSES}
SELECT c_custkey, regexp_matches(low, 'furniture|data') AND CASE WHEN regexp_matches(low, 'france|norway') THEN false WHEN contains(low, 'remote') AND NOT regexp_matches(low, '{_TERMS}') THEN true ELSE regexp_matches(low, '{_TERMS}') OR {_US} OR contains(low, 'austin') END AS passes
FROM (SELECT c_custkey, lower(trim(location)) AS low, upper(trim(location)) AS up FROM addresses)""")  # fmt: skip
def customer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of an ingest, with the place field as the title too."""
    return _addresses(spark, sf_dir).select("c_custkey", filters.passes_gate("location", "location", ["Furniture", "data"], ["france", "norway"], ["austin"]).alias("passes"))


@R.add("jobs_patched", oracle("""
SELECT _id, CASE WHEN title = 'n/a' THEN level || ' Engineer' ELSE title END AS title, CASE WHEN company = 'Unknown' THEN 'Customer ' || userId ELSE company END AS company, CASE WHEN location = 'unknown' THEN country ELSE location END AS location,
  CASE WHEN NOT compensationUnknown THEN totalCompensation WHEN userId % 200 > 0 THEN (30 + userId % 200) * 1000.0 END AS pay, compensationUnknown AND userId % 200 = 0 AS unknown FROM jobs""", "jobs"))  # fmt: skip
def jobs_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job lacks is filled from its description."""
    user = F.col("userId").cast("string")
    body = F.concat(F.lit("# "), "level", F.lit(" Engineer in "), "country", F.lit(" | Customer "), user, F.lit("\n\nPays $"), (30 + F.col("userId") % 200).cast("string"), F.lit("k a year."))
    jobs = shape(spark, sf_dir, "jobs").withColumn("description", body).withColumn("totalCompensation", F.when(~F.col("compensationUnknown"), F.col("totalCompensation")))
    return extract.patched_by_hints(jobs).select("_id", "title", "company", "location", F.col("totalCompensation").alias("pay"), F.col("compensationUnknown").alias("unknown"))


@R.add("seed_listings_dropped", """
SELECT url, title, kept FROM (SELECT url, CASE WHEN page_id % 2 = 0 THEN 'Open Roles' ELSE 'Engineer' END AS title, NOT (page_id % 2 = 0 AND contains(url, '.example.org/')) AS kept FROM pages)""")  # fmt: skip
def seed_listings_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose address is a seed's and whose title is a listing's go; the seeds are the pages of one domain."""
    p = _table(spark, sf_dir, "pages")
    jobs = p.select("url", F.when(F.col("page_id") % 2 == 0, "Open Roles").otherwise("Engineer").alias("title"), F.lit("").alias("description"))
    kept, dropped = filters.seed_listings(jobs, p.where(F.col("url").contains(".example.org/")).select(F.concat("url", F.lit("/")).alias("seed_url")))
    return kept.select("url", "title", F.lit(True).alias("kept")).union(dropped.select("url", "title", F.lit(False).alias("kept")))


@R.add("details_waiting", oracle(f"""
SELECT siteId, count(*) AS n, count(*) FILTER (status = 'pending' AND (attempts < 3 OR coalesce(updatedAt, 0) < {NOW_MS - 86_400_000} OR event_id % 6 < 4)) AS waiting, min(coalesce(createdAt, updatedAt)) AS first_at FROM queue GROUP BY siteId""", "queue"))
def details_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a site that wait for their details."""
    rows = shape(spark, sf_dir, "queue").select(
        "siteId", F.col("status").alias("compensationReason"), F.lit(False).alias("compensationUnknown"), F.lit(1.0).alias("totalCompensation"), F.col("attempts").alias("heuristicAttempts"),
        F.col("updatedAt").alias("heuristicLastTried"), (F.col("event_id") % 6).alias("heuristicVersion"), clock.scheduled_default(F.col("createdAt"), F.col("updatedAt"), F.lit(NOW_MS)).alias("at"),
    )
    return rows.groupBy("siteId").agg(F.count("*").alias("n"), F.count_if(filters.needs_details(NOW_MS)).alias("waiting"), F.min("at").alias("first_at"))


@R.add("patterns_ordered", """
SELECT user_id, f AS field, string_agg(regex, ' ' ORDER BY kind, rank, regex) AS patterns FROM (
  SELECT user_id, f, f || m AS regex, 0 AS kind, -n AS rank FROM (SELECT user_id, event_type AS f, max(CAST(round(value) AS BIGINT)) AS m, count(*) AS n FROM events GROUP BY ALL)
  UNION ALL SELECT DISTINCT user_id, x.f, x.r, 1, x.k FROM events, (VALUES ('click', 'c+', 2), ('click', 'c', 1), ('title', 't', 1)) x(f, r, k)) GROUP BY ALL""")  # fmt: skip
def patterns_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt patterns of each domain (here a user) before the defaults."""
    e = _table(spark, sf_dir, "events")
    n = F.max(F.round("value").cast("long")).cast("string")
    learnt = e.groupBy(F.col("user_id").alias("domain"), F.col("event_type").alias("field")).agg(F.concat(F.first("event_type"), n).alias("regex"), F.count("*").alias("successCount"))
    defaults = spark.createDataFrame([("click", "c+", 2), ("click", "c", 1), ("title", "t", 1)], "field string, regex string, rank long")
    out = extract.ordered_patterns(learnt, defaults)
    return out.select(F.col("domain").alias("user_id"), "field", F.array_join("patterns", " ").alias("patterns"))


def _held(row: Column) -> Column:
    return F.to_json(row)


@R.add("page_postings", r"""
SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS company, 'Role "' || page_id || '"' AS title, substr(url, 1, 5) AS place FROM pages""")
def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured posting of a page, read back from between the page's own markup."""
    post = F.struct(
        F.lit("JobPosting").alias("@type"), F.concat(F.lit('Role "'), F.col("page_id").cast("string"), F.lit('"')).alias("title"),
        F.struct(url.host("url").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.substring("url", 1, 5).alias("addressLocality")).alias("address")).alias("jobLocation"),
    )
    html = F.concat("html", F.lit('<script type="application/ld+json">\n'), _held(post), F.lit("\n</script>"), "html")
    p = payload.job_posting(html)
    return _table(spark, sf_dir, "pages").select("page_id", p["hiringOrganization"]["name"].alias("company"), p["title"].alias("title"), p["jobLocation"]["address"]["addressLocality"].alias("place"))


@R.add("page_board_jobs", "SELECT page_id, id, url || '/' || id AS url, 'Job ' || id AS title FROM (SELECT page_id, url, unnest([page_id, page_id + 1]) AS id FROM pages)")
def page_board_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of a board's listing, with a byte-order mark and words around the object."""
    one = lambda i: F.struct(F.concat("url", F.lit("/"), i.cast("string")).alias("absolute_url"), i.alias("id"), F.concat(F.lit("Job "), i.cast("string")).alias("title"))
    body = F.concat(F.lit("﻿answer: "), F.to_json(F.struct(F.array(one(F.col("page_id")), one(F.col("page_id") + 1)).alias("jobs"))), F.lit(" end"))
    return _table(spark, sf_dir, "pages").select("page_id", F.inline(payload.board_jobs(body))).select("page_id", "id", F.col("absolute_url").alias("url"), "title")


@R.add("page_markdown_links", "SELECT page_id, url AS target, 'Page ' || page_id AS title FROM pages UNION ALL SELECT page_id, '/jobs/' || page_id, 'all' FROM pages")
def page_markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a markdown line; a bracket without an address is none."""
    line = F.concat(F.lit("[x] see [Page "), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") and [all](/jobs/"), F.col("page_id").cast("string"), F.lit(")"))
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(payload.markdown_links(line)).alias("l")).select("page_id", F.col("l.url").alias("target"), F.col("l.title").alias("title"))


@R.add("event_string_leaves", "SELECT event_id, unnest([event_type, 'https://x/' || user_id, 'a \"b\"']) AS leaf FROM events")
def event_string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values of a nested payload, its keys and numbers left out."""
    body = F.to_json(F.struct("event_id", "event_type", F.struct(F.array(F.concat(F.lit("https://x/"), F.col("user_id").cast("string"))).alias("links"), F.lit('a "b"').alias("note")).alias("props")))
    return _table(spark, sf_dir, "events").select("event_id", F.explode(payload.string_leaves(body)).alias("leaf"))


@R.add("conversation_words_distinct", rf"""
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT conv_id, turn, arg_min(w, i) AS w, min(i) AS i FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
  SELECT conv_id, turn, string_split_regex(text, '[\x20\x09-\x0D]+') AS ws FROM conversations)) WHERE w <> '' GROUP BY conv_id, turn, lower(w)) GROUP BY conv_id, turn""")  # fmt: skip
def conversation_words_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words without repeats, the first spelling kept."""
    words = text.distinct_in_order(F.split("text", r"[\x20\x09-\x0D]+"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@R.add("scrapes_trimmed", "SELECT page_id, length(html) AS n_chars, substr(html, 1, 8000) AS payload FROM pages")
def scrapes_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads are cut to the store's size, which is the feature, with their former length beside them."""
    return ingest.trimmed(_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("payload"))).select("page_id", "n_chars", "payload")


@R.add("page_banners_cut", "SELECT page_id, html AS body FROM pages")
def page_banners_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of cookie notices, empty links and lone tags around a page's text go; the page's own stay."""
    body = F.concat(F.lit("We use cookies to serve you\n[ ](/home)\n<div class='x'>\n"), "html", F.lit("\nAccept all cookies\n"), F.lit("</div>"))
    return _table(spark, sf_dir, "pages").select("page_id", extract.cut_banner(body).alias("body"))
