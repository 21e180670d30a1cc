"""Queries over what a page is and what stands around its posting, form plans, scrape logs, shown pay and checked leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import NOW_MS, oracle, shape
from harborlight.functions import markdown, pages, payload
from harborlight.operators import forms, queue, rollups, views
from harborlight.plans import board
from harborlight.plans.registry import Registry
from harborlight.plans.work import _LEASE

R = Registry()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines before a text whose number, order, density and depth vary by document; both engines compute them.
_NOTICE = """repeat('Opening line' || chr(10), doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '<div><br></div>' || chr(10) ELSE '' END
 || CASE doc_id % 5 WHEN 0 THEN 'This website  uses cookies' || chr(10) WHEN 1 THEN 'Cookie Policy' || chr(10) WHEN 2 THEN 'Google Analytics' || chr(10) ELSE 'Plain words' || chr(10) END
 || repeat('Between' || chr(10), doc_id % 7 * 45) || CASE doc_id % 4 WHEN 0 THEN 'We set COOKIES, accept ALL' || chr(10) WHEN 1 THEN 'Manage cookies' || chr(10) ELSE 'reject all' || chr(10) END
 || CASE WHEN doc_id % 3 = 0 THEN ' Preferences ' || chr(10) || '</p>' || chr(10) || chr(10) ELSE 'Preferences, yours' || chr(10) END || coalesce(text, '')"""
_SIGNAL = "(?i)" + "|".join(w.replace(" ", r"\s+") for w in markdown.COOKIE_SIGNALS)
_CONTROL = r"(?i)^\s*(?:" + "|".join(w.replace(" ", r"\s+") for w in markdown.COOKIE_CONTROLS) + r")\s*$"
_STRIP = r"regexp_replace(body, '^\n+|\n+$', '', 'g')"
_LINES = r"l AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(body, '\r?\n') AS x FROM t))"


@R.add("document_notice_cut", rf"""
WITH t AS (SELECT doc_id, {_NOTICE} AS body FROM documents), {_LINES},
f AS (SELECT *, regexp_matches(s, '{_SIGNAL}') AS hit, regexp_matches(s, '(?i)\bcookies?\b') AS named, regexp_matches(s, '^\s*$') OR (regexp_matches(s, '^\s*<.*>\s*$') AND trim(regexp_replace(s, '<[^>]*>', '', 'g'), ' ') = '') AS soft, regexp_matches(s, '{_CONTROL}') AS control FROM l),
e AS (SELECT doc_id, min(i) FILTER (hit) AS a, max(i) FILTER (hit) AS z FROM f GROUP BY doc_id HAVING count(*) FILTER (hit) >= 2 AND count(*) FILTER (named) >= 2 AND z - a <= 240),
g AS (SELECT doc_id, coalesce(max(i) FILTER (i < a AND NOT soft), 0) AS last_before, coalesce(min(i) FILTER (i > z AND NOT soft AND NOT control), 1000000000) AS first_after FROM f JOIN e USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (i <= last_before OR i >= first_after), '') AS body FROM l JOIN g USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN k.doc_id IS NULL THEN t.body ELSE coalesce(nullif(regexp_replace(k.body, '^\n+|\n+$', '', 'g'), ''), regexp_replace(t.body, '^\n+|\n+$', '', 'g')) END AS body FROM t LEFT JOIN k USING (doc_id)""")  # fmt: skip
def document_notice_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind a cookie notice of varying length, signals and surroundings."""
    return _table(spark, sf_dir, "documents").select("doc_id", markdown.cut_notice(F.expr(_NOTICE)).alias("body"))


_MENU = """repeat('Opening line' || chr(10), doc_id % 5 * 35) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  ' || chr(10) ELSE '' END
 || repeat('## Sales' || chr(10) || ' Marketing ' || chr(10) || repeat('Some words' || chr(10), doc_id % 4) || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END, doc_id % 11 + doc_id % 2 * doc_id % 13 * 3)
 || CASE WHEN doc_id % 6 = 0 THEN chr(10) || '#Careers' || chr(10) ELSE 'sales' || chr(10) END || coalesce(text, '')"""
_WORDS = ", ".join(f"'{w}'" for w in [*markdown.MENU, "Careers"])


@R.add("document_menu_cut", rf"""
WITH t AS (SELECT doc_id, {_MENU} AS body FROM documents), {_LINES},
f AS (SELECT *, regexp_replace(regexp_replace(s, '^\s*#*\s*', ''), '\s+$', '') IN ({_WORDS}) AS word, regexp_matches(s, '^\s*$') AS blank FROM l),
e AS (SELECT doc_id, min(i) AS a, max(i) AS z, count(*) AS hits FROM f WHERE word AND i <= 200 GROUP BY doc_id HAVING hits >= 8 AND a <= 121),
d AS (SELECT doc_id, a, z FROM f JOIN e USING (doc_id) GROUP BY doc_id, a, z, hits HAVING hits >= greatest(8, floor(count(*) FILTER (NOT blank AND i BETWEEN a AND z) * 0.6))),
g AS (SELECT doc_id, coalesce(max(i) FILTER (i < a AND NOT blank), 0) AS last_before, coalesce(min(i) FILTER (i > z AND NOT blank AND NOT word), 1000000000) AS first_after FROM f JOIN d USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (i <= last_before OR i >= first_after), '') AS body FROM l JOIN g USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN k.doc_id IS NULL THEN t.body ELSE coalesce(nullif(regexp_replace(k.body, '^\n+|\n+$', '', 'g'), ''), regexp_replace(t.body, '^\n+|\n+$', '', 'g')) END AS body FROM t LEFT JOIN k USING (doc_id)""")  # fmt: skip
def document_menu_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind a menu of varying length, density, depth and surroundings."""
    return _table(spark, sf_dir, "documents").select("doc_id", markdown.cut_menu(F.expr(_MENU)).alias("body"))


_CARD = """coalesce(text, '') || CASE conv_id % 5 WHEN 0 THEN chr(10) || 'Apply now' WHEN 1 THEN chr(10) || 'Direct apply' || chr(10) || 'View job' WHEN 2 THEN chr(10) || 'Qualifications, view details' ELSE '' END
 || CASE turn % 3 WHEN 0 THEN chr(10) || 'Posted 3 days ago at https://a.example.com/Jobs/).' WHEN 1 THEN chr(10) || 'see https://a.example.com/jobs7/careers' ELSE chr(10) || 'http://b.example.com/x/openings;' END"""
_HITS = lambda c, words: " + ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')::INT" for w in words)
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@R.add("listing_cards", rf"""
WITH c AS (SELECT conv_id, turn, role, {_CARD} AS body FROM conversations),
s AS (SELECT *, {_TRIM.format('body')} AS b, substr(regexp_replace(lower(coalesce(role, '') || ' ' || body), '\s+', ' ', 'g'), 1, 2000) AS s FROM c),
m AS (SELECT *, {_HITS('s', pages.DETAIL_MARKERS)} AS details, {_HITS('s', pages.CARD_BUTTONS)} AS buttons, len(regexp_extract_all(b, '[\p{{L}}\p{{N}}_]+')) AS words,
  list_transform(regexp_extract_all(body, '(?i:https?)://\S+'), lambda u: regexp_replace(u, '[).,;\]"'']+$', '')) AS links FROM s)
SELECT conv_id, turn, role, details = 0 AND length(b) BETWEEN 1 AND 500 AND words <= 120 AND len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) <= 14 AND buttons >= 1
  AND len(list_filter(links, lambda u: regexp_matches(lower(u), '^https?://[^/?#]+(/[^/?#0-9]*)*/(jobs|careers|career|positions|openings)/*([?#]|$)'))) > 0 AND (contains(s, 'posted') AND contains(s, 'ago') OR buttons >= 2 AND words <= 80) AS card FROM m""")  # fmt: skip
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with buttons, times and addresses behind them: which look like the card of a listing."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", pages.is_listing_card("role", F.expr(_CARD), F.lit(None).cast("string")).alias("card"))


_FRAMED = """CASE doc_id % 4 WHEN 0 THEN 'Job Alerts' || chr(10) WHEN 1 THEN 'Saved jobs and JOB ALERTS ' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN ' Requirements' ELSE ' Your Salary' END"""


@R.add("document_structured_preferred", rf"""
SELECT doc_id, length(b) < 200 OR {_HITS('b', pages.FRAME_MARKERS)} >= 2 OR {_HITS('b', pages.DETAIL_MARKERS)} = 0 AS structured FROM (SELECT doc_id, lower({_TRIM.format('(' + _FRAMED + ')')}) AS b FROM documents)""")  # fmt: skip
def document_structured_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", pages.prefers_structured(F.expr(_FRAMED)).alias("structured"))


#: Payloads of one or more positions, with marks of several kinds or none.
_DETAIL = """'{"x": ' || value || CASE event_id % 5 WHEN 0 THEN ', "singleview": true' WHEN 1 THEN ', "singleview": 0' WHEN 2 THEN ', "singleview": "1"' WHEN 3 THEN ', "singleview": 1' ELSE '' END
 || CASE event_id % 4 WHEN 0 THEN ', "positions": [' || props || ']' WHEN 1 THEN ', "positions": [1, ' || props || ']' WHEN 2 THEN ', "positions": ' || props ELSE '' END
 || CASE user_id % 3 WHEN 0 THEN ', "pid": "p' || user_id || '"' WHEN 1 THEN ', "pid": ""' ELSE '' END || CASE user_id % 7 WHEN 0 THEN ', "count": 1' WHEN 1 THEN ', "count": 2' ELSE '' END || '}'"""


@R.add("event_detail_payloads", f"""
SELECT event_id, coalesce(j->>'$.singleview' = 'true', false) OR coalesce(json_type(j, '$.singleview') IN ('BIGINT', 'UBIGINT') AND j->>'$.singleview' = '1', false)
 OR coalesce(json_type(j, '$.positions') = 'ARRAY' AND json_array_length(j, '$.positions') = 1 AND (coalesce(j->>'$.pid', '') <> '' OR coalesce(j->>'$.count' = '1', false)), false) AS detail FROM (SELECT event_id, ({_DETAIL})::JSON AS j FROM events)""")  # fmt: skip
def event_detail_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", pages.is_detail_payload(payload.variant(F.expr(_DETAIL))).alias("detail"))


_BLOCK = """'## Location' || CASE WHEN doc_id % 3 = 0 THEN ': Area ' || source || chr(10) || 'more' ELSE chr(10) || chr(10) || '- Area ' || source END || chr(10) || 'Req ID' || chr(10) || 'R10' || doc_id || chr(10) || 'Job Description' || chr(10) || 'Words. ' || coalesce(lang, 'none')"""
_NAMED = "CASE doc_id % 4 WHEN 0 THEN ' area ' || source WHEN 1 THEN 'Area' WHEN 2 THEN 'r10' || doc_id ELSE coalesce(lang, '') END"


@R.add("document_metadata_titles", "SELECT doc_id, doc_id % 4 = 0 AND source IS NOT NULL AS taken FROM documents")
def document_metadata_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that a block of labels before the posting gives as a place, inline or a line below; numbers behind a label that isn't listed don't count."""
    return _table(spark, sf_dir, "documents").select("doc_id", pages.title_is_metadata(F.expr(_BLOCK), F.expr(_NAMED)).alias("taken"))


_PLACE = """CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ', ' || p_type WHEN 2 THEN 'Remote ' || p_name WHEN 3 THEN p_name || ', ' || p_brand || ', x, y' ELSE p_name || CASE WHEN p_partkey % 2 = 0 THEN ' package' ELSE '' END END"""
_NOT_PLACE = " OR ".join(f"contains(lower(v), '{w}')" for w in pages.NO_PLACE_WORDS)


@R.add("part_places", rf"""
SELECT p_partkey, length(v) BETWEEN 2 AND 100 AND lower(v) NOT IN ('unknown', 'n/a', 'na') AND NOT ({_NOT_PLACE}) AND CASE WHEN contains(v, ',') THEN len(parts) <= 3 AND len(list_filter(parts, lambda p: len(regexp_extract_all(p, '\S+')) > 3)) = 0
 ELSE contains(lower(v), 'remote') OR len(regexp_extract_all(v, '\S+')) <= 4 END AS plausible FROM (SELECT p_partkey, v, list_filter(list_transform(string_split(v, ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM (SELECT p_partkey, {_PLACE} AS v FROM part))""")  # fmt: skip
def part_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which spellings of part names, brands and types could be a place."""
    return _table(spark, sf_dir, "part").select("p_partkey", pages.is_plausible_place(F.expr(_PLACE)).alias("plausible"))


_BOARD = """CASE page_id % 6 WHEN 0 THEN 'https://boards.greenhouse.io/acme' || page_id WHEN 1 THEN 'https://boards-api.greenhouse.io/v1/boards/acme/jobs/' WHEN 2 THEN 'https://boards.greenhouse.io/acme/jobs/' || page_id
 WHEN 3 THEN 'https://Job-Boards.Greenhouse.io/acme/Jobs?x=' || page_id WHEN 4 THEN 'https://boards.greenhouse.io/' ELSE url END"""


@R.add("page_board_addresses", rf"""
SELECT page_id, regexp_matches(lower(u), '^https?://([^/?#]*\.)?greenhouse\.io(/[^?#]*)?/jobs/*([?#]|$)') OR regexp_matches(lower(u), '^https?://([^/?#]*\.)?boards\.greenhouse\.io/[^/?#]+/*([?#]|$)') AS board FROM (SELECT page_id, {_BOARD} AS u FROM pages)""")  # fmt: skip
def page_board_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", pages.is_board_address(F.expr(_BOARD)).alias("board"))


#: A turn as a form's field: what it says is the label, its role and number the rest.
_FIELD = [
    "conv_id AS form", "turn AS field", "conv_id AS person", "CASE role WHEN 'system' THEN 'select' ELSE 'input' END AS tag", "CASE turn % 4 WHEN 1 THEN 'email' WHEN 2 THEN 'tel' WHEN 3 THEN 'file' ELSE 'text' END AS kind",
    "text AS label", "CASE WHEN conv_id % 3 = 0 THEN 'Market segment' WHEN conv_id % 3 = 1 THEN 'Your given name' END AS placeholder", "CASE WHEN turn % 2 = 0 THEN 'Balance due' END AS name", "CASE WHEN turn % 5 = 0 THEN 'nation key' END AS id",
]
_ENTRIES = """SELECT c_custkey AS person, 'email' AS entry, lower(replace(c_name, '#', '')) || '@example.com' AS value FROM {c} UNION ALL SELECT c_custkey, 'first_name', c_name FROM {c} UNION ALL SELECT c_custkey, 'last_name', c_mktsegment FROM {c}
UNION ALL SELECT c_custkey, 'market_segment', c_mktsegment FROM {c} UNION ALL SELECT c_custkey, 'balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(40)) FROM {c} UNION ALL SELECT c_custkey, 'nation_key', CAST(c_nationkey AS VARCHAR(20)) FROM {c}
UNION ALL SELECT c_custkey, 'phone', '+' || c_custkey FROM {c} WHERE c_custkey % 2 = 0"""
_RULE = "CASE " + " ".join("WHEN " + " OR ".join([f"contains(low, '{w}')" for w in ws] + (["low = 'name'"] if k == "full_name" else [])) + f" THEN '{k}'" for k, ws in forms.ENTRY_WORDS) + " END"


@R.add("conversation_form_plan", rf"""
WITH c AS (SELECT DISTINCT * FROM (SELECT {', '.join(_FIELD)} FROM conversations)), e0 AS ({_ENTRIES.format(c='customer')}), e AS (SELECT * FROM e0 UNION ALL SELECT person, 'full_name', max(value) FILTER (entry = 'first_name') || ' ' || max(value) FILTER (entry = 'last_name') FROM e0 GROUP BY person),
lab AS (SELECT form, field, n, low, {_RULE} AS rule FROM (SELECT form, field, unnest([1, 2, 3, 4]) AS n, lower({_TRIM.format("unnest([coalesce(label, ''), coalesce(placeholder, ''), coalesce(name, ''), coalesce(id, '')])")}) AS low FROM c)),
r AS (SELECT form, field, arg_min(rule, n) FILTER (rule IS NOT NULL) AS rule FROM lab GROUP BY ALL),
w AS (SELECT DISTINCT form, field, person, unnest(regexp_extract_all(lower(concat_ws(' ', label, placeholder, name, id)), '[\p{{L}}\p{{N}}]+')) AS word FROM c JOIN r USING (form, field) WHERE rule IS NULL),
ew AS (SELECT person, entry, len(string_split(entry, '_')) AS size, unnest(string_split(entry, '_')) AS word FROM e),
h AS (SELECT form, field, entry, count(*) AS hits, any_value(size) AS size FROM w JOIN ew USING (person, word) GROUP BY ALL),
b AS (SELECT form, field, arg_min(entry, (-hits / size, -hits, entry)) AS best FROM h WHERE hits * 2 >= size GROUP BY ALL),
p AS (SELECT c.*, coalesce(rule, best) AS entry FROM c JOIN r USING (form, field) LEFT JOIN b USING (form, field)),
v AS (SELECT p.*, e.value, CASE WHEN e.value IS NULL AND kind IN ('email', 'tel') THEN CASE kind WHEN 'tel' THEN 'phone' ELSE 'email' END END AS by_kind FROM p LEFT JOIN e ON e.person = p.person AND e.entry = p.entry)
SELECT v.form, v.field, CASE WHEN tag = 'select' THEN 'select' WHEN kind = 'file' THEN 'upload' ELSE 'type' END AS op, CASE WHEN e.value IS NULL THEN v.entry ELSE by_kind END AS entry, coalesce(v.value, e.value) AS value FROM v LEFT JOIN e ON e.person = v.person AND e.entry = by_kind""")  # fmt: skip
def conversation_form_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a form's field, filled from the customer of the conversation's number."""
    fields = _table(spark, sf_dir, "conversations").selectExpr(*_FIELD).distinct()
    entries = spark.sql(_ENTRIES.format(c="{c}"), c=_table(spark, sf_dir, "customer"))
    return forms.fill_plan(fields, entries).select("form", "field", "op", "entry", "value")


@R.add("page_scrape_log", oracle(r"""
SELECT scrapeId, a."at", a.url, CASE WHEN why = 'no_items' AND jobId IS NOT NULL THEN 'no_items_existing_job' ELSE coalesce(why, CASE WHEN jobId IS NOT NULL THEN 'already_saved' END) END AS reason,
 CASE WHEN jobId IS NOT NULL OR why IN ('no_items', 'listing_only') THEN 'skipped' ELSE 'scraped' END AS action, jobId, row_count AS "rowCount", link_count AS "linkCount" FROM a LEFT JOIN j ON rtrim(a.url, '/') = j.k""", "postings", ctes=r"""
x AS (SELECT page_id, url, source_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS found FROM postings),
n AS (SELECT page_id, url AS src, CASE WHEN source_id > 4 THEN list_transform(found, lambda u: CASE WHEN length(u) % 4 = 0 THEN ' ' WHEN starts_with(u, '/') THEN regexp_extract(url, '^[^/]*//[^/]*', 0) || u ELSE u END) ELSE [] END AS r, CASE WHEN source_id > 1 THEN found ELSE [] END AS l FROM x),
i AS (SELECT page_id, src, len(r) AS row_count, len(l) AS link_count, unnest(CASE WHEN len(r) > 0 THEN r WHEN len(l) > 0 THEN l ELSE [src] END) AS u, CASE WHEN len(r) > 0 THEN NULL WHEN len(l) > 0 THEN 'listing_only' ELSE 'no_items' END AS why FROM n),
a AS (SELECT 's' || page_id AS scrapeId, page_id * 1000 AS "at", CASE WHEN trim(u) = '' THEN src ELSE trim(u) END AS url, CASE WHEN row_count > 0 AND trim(u) = '' THEN 'missing_url' ELSE why END AS why, row_count, link_count FROM i),
j AS (SELECT rtrim(trim(url), '/') AS k, min('j' || page_id) AS jobId FROM postings WHERE length(html) % 2 = 0 GROUP BY k)"""))  # fmt: skip
def page_scrape_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a scrape of its links, as rows, as raw addresses or as nothing, against the pages that are jobs already."""
    p = shape(spark, sf_dir, "postings")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    site = F.regexp_extract("url", "^[^/]*//[^/]*", 0)
    rows = F.transform(found, lambda u: F.when(F.length(u) % 4 == 0, " ").when(u.startswith("/"), F.concat(site, u)).otherwise(u))
    scrapes = p.select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("scrapeId"), (F.col("page_id") * 1000).alias("at"), F.col("url").alias("sourceUrl"),
                       F.when(F.col("source_id") > 4, rows).alias("rows"), F.when(F.col("source_id") > 1, found).alias("links"))
    jobs = p.where("length(html) % 2 = 0").select(F.concat(F.lit("j"), F.col("page_id").cast("string")).alias("_id"), "url")
    out = views.scrape_log(scrapes, jobs)
    return out.withColumns({"rowCount": F.col("rowCount").cast("long"), "linkCount": F.col("linkCount").cast("long")})


_KEY = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')"


@R.add("job_pay_shown", oracle(f"""
SELECT _id, CASE WHEN v IS NULL THEN 'Unknown' ELSE CASE currencyCode WHEN 'EUR' THEN '€' ELSE '$' END || format('{{:,}}', CAST(floor(v + 0.5) AS BIGINT)) END AS "payShown", unknown AND v IS NULL AS "payUnknown", unknown AND v IS NOT NULL AS "payEstimated",
 CASE WHEN NOT unknown THEN scraper || ' extracted compensation' WHEN v IS NULL THEN 'pending markdown structured extraction' ELSE 'Company salary cap from config' || CASE WHEN level IN ('junior', 'mid', 'senior', 'staff') THEN '' ELSE ' (mid-level fallback)' END END AS "payReason"
FROM (SELECT *, CASE WHEN unknown THEN CASE level WHEN 'junior' THEN cap_junior WHEN 'senior' THEN cap_senior WHEN 'staff' THEN cap_staff ELSE cap_mid END ELSE totalCompensation END AS v
 FROM (SELECT _id, company, currencyCode, totalCompensation, compensationUnknown AS unknown, 'w' || userId % 3 AS scraper, CASE WHEN country = 'Canada' THEN NULL WHEN country = 'Germany' THEN 'lead' ELSE level END AS level FROM jobs) n LEFT JOIN caps ON {_KEY.format('n.company')} = k)""", "jobs",
 ctes=f"caps AS (SELECT {_KEY.format('company')} AS k, * EXCLUDE (company) FROM ({board.R.oracles['company_pay_caps']}))"))
def job_pay_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job pays as it is shown, unknown pay by the caps of its company at its level, at the middle one, or not at all."""
    j = shape(spark, sf_dir, "jobs")
    level = F.when(F.col("country") == "Canada", None).when(F.col("country") == "Germany", "Lead ").otherwise(F.col("level"))
    j = j.withColumn("level", level).withColumn("scrapedWith", F.concat(F.lit("w"), (F.col("userId") % 3).cast("string")))
    return rollups.pay_shown(j, board.company_pay_caps(spark, sf_dir)).select("_id", "payShown", "payUnknown", "payEstimated", "payReason")


_SIGN_IN = "CASE WHEN siteId IS NULL THEN replace(url, '/jobs/', '/Login/') ELSE url END"


@R.add("queue_lease_checked", oracle("""
SELECT url, CASE WHEN attempts + 1 > 3 THEN 'max_attempts_exceeded' WHEN contains(url, '/Login/') THEN 'auth_url' WHEN updatedAt IS NULL THEN 'skip_listed_url' END AS error FROM (SELECT * FROM turns ORDER BY turn, lead LIMIT 100)""", "queue",
 ctes=f"q AS (SELECT * REPLACE ({_SIGN_IN} AS url) FROM queue), {_LEASE.replace('FROM queue', 'FROM q')}"))
def queue_lease_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with what is skipped of it: sign-in pages, and addresses that were never updated and are listed as seen."""
    q = shape(spark, sf_dir, "queue").withColumn("url", F.expr(_SIGN_IN))
    out = queue.lease_fit(q, q.where("updatedAt is null").select("sourceUrl", "url"), NOW_MS, 100)
    return out["leased"].select("url", F.lit(None).cast("string").alias("error")).union(out["skipped"])


@R.add("queue_settled", oracle(f"""
SELECT url, coalesce(CASE w WHEN 0 THEN 'completed' WHEN 1 THEN 'invalid' WHEN 2 THEN 'failed' END, status) AS status, CASE w WHEN 1 THEN 'invalid_job_data' WHEN 2 THEN 'store_scrape_failed' END AS error, CASE WHEN w = 0 THEN {NOW_MS} END AS "completedAt"
FROM queue LEFT JOIN (SELECT url, max(w) AS w FROM (SELECT url, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS w FROM queue WHERE status = 'processing' UNION ALL SELECT url, 0 FROM queue WHERE status = 'processing') GROUP BY url) USING (url)
WHERE NOT coalesce(w = 2 AND attempts >= 3, false)""", "queue"))  # fmt: skip
def queue_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scrapes of each address in work, the worse of which settles it."""
    q = shape(spark, sf_dir, "queue")
    work = q.where("status = 'processing'")
    outcome = F.when(F.col("event_id") % 3 == 0, "stored").when(F.col("event_id") % 3 == 1, "invalid_scrape").otherwise("timeout")
    by_link = work.select(F.array(F.lit(None), F.lit(" "), F.col("url"), F.lit("x")).alias("subUrls"), "sourceUrl", outcome.alias("outcome"))
    by_source = work.select(F.array(F.lit("")).alias("subUrls"), F.concat(F.lit(" "), "url").alias("sourceUrl"), F.lit("stored").alias("outcome"))
    return queue.complete(q, queue.verdicts(by_link.unionByName(by_source)), NOW_MS)["queue"].select("url", "status", "error", "completedAt")
