"""Scraped bodies read: HTML to lines, page furniture cut, metadata split off, error and listing pages told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import oracle, shape
from harborlight.functions import markdown, text
from harborlight.plans.registry import Registry

R = Registry()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))


def _entities(sql: str) -> str:
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        sql = f"regexp_replace({sql}, '{name}', '{char}', 'gi')"
    return sql


_MARKDOWN = "html"
for _p, _by in (
    (r"(?is)<script\b[^>]*>.*?</script>", "' '"),
    (r"(?is)<style\b[^>]*>.*?</style>", "' '"),
    (r"(?s)<!--.*?-->", "''"),
    (r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/ul|/ol|/section|/article)\b[^>]*>", "chr(10)"),
    (r"(?i)<li\b[^>]*>", "'- '"),
    (r"<[^>]+>", "''"),
):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_p}', {_by}, 'g')"
_MARKDOWN = f"regexp_replace({_entities(_MARKDOWN)}, '[ \\t]+', ' ', 'g')"
_MARKDOWN = rf"trim(regexp_replace(regexp_replace({_MARKDOWN}, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"


@R.add("page_markdown", f"SELECT page_id, {_MARKDOWN} AS body FROM pages")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markdown.html_markdown("html").alias("body"))


_TITLE = _entities(r"regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')")
_TITLE = rf"nullif(trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')), '')"


@R.add("page_descriptions", rf"SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat_ws(chr(10) || chr(10), {_TITLE}, 'About ' || url) WHEN 1 THEN concat_ws(chr(10) || chr(10), {_TITLE}, 'At ' || url) END AS description FROM pages")
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages given a description, an Open Graph one or none, attributes in either order, before their title."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    og = F.concat(F.lit('<META property="og:description" content="'), F.when(F.col("page_id") % 3 == 0, "wrong").otherwise(F.concat(F.lit("At  "), F.col("url"))), F.lit('">'))
    own = F.concat(F.lit("<meta content='About "), F.col("url"), F.lit("' name=\"description\"/>"))
    head = F.when(F.col("page_id") % 3 == 0, F.concat(og, own)).when(F.col("page_id") % 3 == 1, og).otherwise("")
    return p.select("page_id", markdown.meta_description(F.replace(F.col("html"), F.lit("<title>"), F.concat(head, F.lit("<title>")))).alias("description"))


_FURNITURE = "chr(10) || '* [' || chr(10) || '[ ](#)' || chr(10) || '  <div class=\"x\"><br></div> ' || chr(10) || 'Mail_Outline now' || chr(10) || 'BACK' || chr(10) || 'ABCD_1234.X' || chr(10) || '{\"display_text\": 1, \"b\": 2}' || chr(10) || '{\"a\": 1}' || chr(10) || 'kept <b>line</b>'"
_JUNK = r"""regexp_matches(s, '^\s*<.*>\s*$') AND trim(regexp_replace(s, '<[^>]*>', '', 'g'), ' ') = ''
 OR regexp_matches(s, '^\s*(?:\[|[*\-•] \[|[*\-•]?\s*\[\s*\]|\]\(\s*#?\s*\)|\[\s*\]\(\s*#?\s*\))\s*$')
 OR regexp_matches(lower(s), 'carousel_paragraph|get future jobs matching this search|job_description\.share\.html|loginorregister|mail_outline|enable javascript to run this app') OR lower(trim(s, ' ')) = 'back' OR regexp_matches(s, '^\s*[A-Z0-9_.]{8,}\s*$')
 OR regexp_matches(trim(s, ' '), '^[\[{].*[\]}]$') AND len(regexp_extract_all(s, '":')) >= 2 AND (contains(s, '"display_banner"') OR contains(s, '"display_text"'))"""


@R.add("document_stripped", rf"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, '') || {_FURNITURE}, '\r?\n'), lambda s: NOT ({_JUNK})), chr(10)) AS body FROM documents")
def document_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with page furniture behind them: only the JSON line without a banner and the line of words stay."""
    tail = F.lit('\n* [\n[ ](#)\n  <div class="x"><br></div> \nMail_Outline now\nBACK\nABCD_1234.X\n{"display_text": 1, "b": 2}\n{"a": 1}\nkept <b>line</b>')
    return _docs(spark, sf_dir).select("doc_id", markdown.strip_known_blocks(F.concat("text", tail)).alias("body"))


@R.add("document_tail_cut", r"SELECT doc_id, coalesce(nullif(regexp_replace(coalesce(text, ''), '^\n+|\n+$', '', 'g'), ''), coalesce(text, '') || chr(10) || 'See SIMILAR jobs here' || chr(10) || coalesce(lang, '')) AS body FROM documents")
def document_tail_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", markdown.cut_tail(F.concat("text", F.lit("\nSee SIMILAR jobs here\n"), F.coalesce("lang", F.lit("")))).alias("body"))


@R.add("document_theme_cut", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{}', '()') || '  {"x": {}} end', '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS body FROM documents""")  # fmt: skip
def document_theme_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theme object in the middle goes with all that it nests; an object without a theme stays."""
    plain = F.translate("text", "{}", "()")
    return _docs(spark, sf_dir).select("doc_id", markdown.cut_theme_objects(F.concat(plain, F.lit('{"a": {"customTheme": {"b": {"c": 1}}}, "d": [2]} {"x": {}} end'))).alias("body"))


_HEAD = "'## Location' || chr(10) || coalesce(lang, 'any') || chr(10) || 'Req ID' || chr(10) || 'R' || (10000 + doc_id)"
_BODY = r"regexp_replace(translate(coalesce(text, ''), '#*_-', ''), '\r', '', 'g')"


@R.add("document_metadata", rf"""
SELECT doc_id, CASE WHEN regexp_matches({_BODY}, '^\s*$') THEN CASE WHEN doc_id % 2 = 0 THEN {_HEAD} ELSE 'A longer first line, closed.' END
  WHEN doc_id % 2 = 0 THEN regexp_replace({_BODY}, '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g')
  ELSE 'A longer first line, closed.' || chr(10) || chr(10) || regexp_replace({_BODY}, '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g') END AS description,
  CASE WHEN doc_id % 2 = 0 AND NOT regexp_matches({_BODY}, '^\s*$') THEN {_HEAD} END AS metadata FROM documents""")  # fmt: skip
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind a block of labels, or behind a line of words, and a description heading."""
    head = F.concat(F.lit("## Location\n"), F.coalesce("lang", F.lit("any")), F.lit("\nReq ID\nR"), (F.col("doc_id") + 10000).cast("string"))
    before = F.when(F.col("doc_id") % 2 == 0, head).otherwise("A longer first line, closed.")
    body = F.regexp_replace(F.translate("text", "#*_-", ""), "\r", "")
    parts = markdown.split_description(F.concat(before, F.lit("\n---\n** Job  Description: \n\n"), body))
    return _docs(spark, sf_dir).select("doc_id", parts["description"].alias("description"), parts["metadata"].alias("metadata"))


_PHRASES = "|".join(p.replace("'", "''") for p in text.ERROR_PHRASES)
_BOTH = "lower(title || ' ' || body)"


@R.add("error_pages", rf"""
SELECT doc_id, regexp_matches(s, '\b404\b') OR regexp_matches(s, '{_PHRASES}') AS gone FROM (SELECT doc_id, substr(regexp_replace({_BOTH}, '\s+', ' ', 'g'), 1, 700) AS s FROM
(SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Error 404' WHEN 1 THEN 'The position  has been Filled' WHEN 2 THEN 'Room 4040' ELSE '' END AS title, coalesce(text, '') || CASE WHEN doc_id % 8 = 3 THEN ' job is closed' ELSE '' END AS body FROM documents) t) u""")  # fmt: skip
def error_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase behind a text counts only within its first 700 characters."""
    k = F.col("doc_id") % 8
    title = F.when(k == 0, "Error 404").when(k == 1, "The position  has been Filled").when(k == 2, "Room 4040").otherwise("")
    return _docs(spark, sf_dir).select("doc_id", text.is_error_landing(title, F.concat("text", F.when(k == 3, " job is closed").otherwise(""))).alias("gone"))


_MARKS = " + ".join(f"contains(s, '{m}')::INT" for m in text.LISTING_MARKERS)


@R.add("listing_pages", rf"""
SELECT doc_id, len(body) > 0 AND (contains(s, 'open positions') AND (contains(s, 'search for opportunities') OR sel >= 1) OR m >= 4 OR m >= 3 AND sel >= 1 OR sel >= 3 AND m >= 1 OR links >= 8 AND m >= 2) AS listing FROM
(SELECT *, {_MARKS} AS m, len(regexp_extract_all(s, '\bselect\b')) AS sel, (len(body) - len(replace(body, '](', ''))) / 2 AS links FROM
(SELECT doc_id, body, substr(regexp_replace(lower(title || ' ' || body), '\s+', ' ', 'g'), 1, 2000) AS s FROM
(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Open positions, select a team' WHEN 1 THEN 'Search jobs All teams' WHEN 2 THEN 'Select select SELECT filter by' ELSE 'Job' END AS title, coalesce(text, '') || CASE WHEN doc_id % 6 = 1 THEN repeat('[a](b) ', 8) ELSE '' END AS body FROM documents) t) u) v""")  # fmt: skip
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    title = F.when(k == 0, "Open positions, select a team").when(k == 1, "Search jobs All teams").when(k == 2, "Select select SELECT filter by").otherwise("Job")
    return _docs(spark, sf_dir).select("doc_id", text.is_listing_page(title, F.concat("text", F.when(k == 1, "[a](b) " * 8).otherwise(""))).alias("listing"))


@R.add("titles_before_bar", oracle("SELECT _id, title, CASE WHEN title = 'n/a' THEN NULL ELSE title END AS applied FROM (SELECT _id, CASE WHEN title = 'n/a' THEN 'n/a' ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS title FROM jobs) t", "jobs"))
def titles_before_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    squeezed = F.trim(F.regexp_replace("title", r"\s+", " "))
    bar = F.concat(squeezed, F.when(F.col("title") != "n/a", F.concat(F.lit(" in "), F.col("location"), F.lit(" | "), F.col("company"))).otherwise(""))
    said = F.when(F.col("title") != "n/a", F.concat(F.lit("Job application for "), squeezed, F.lit(" at "), F.col("company"))).otherwise(squeezed)
    return shape(spark, sf_dir, "jobs").select("_id", markdown.title_before_bar(bar).alias("title"), markdown.application_title(said).alias("applied"))


@R.add("texts_replaced", oracle("SELECT _id, company <> 'Unknown' AND company <> title OR company = 'Unknown' AND lower(title) = 'n/a' AS takes, CAST(floor(totalCompensation) AS BIGINT) AS pay, CASE WHEN url = '' THEN '/' ELSE regexp_replace(url, '/+$', '') END AS path FROM jobs", "jobs"))
def texts_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.format_number("totalCompensation", 2)
    return shape(spark, sf_dir, "jobs").select("_id", markdown.should_replace("company", "title").alias("takes"), markdown.whole_number(paid).alias("pay"), markdown.clean_path("url").alias("path"))


@R.add("provider_documents", "SELECT event_id, props AS json_doc, event_type AS text_doc, 'u' || user_id || CASE WHEN event_id % 2 = 0 THEN '|b' ELSE '' END AS urls FROM events")
def provider_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON and the first plain document of a provider's status; addresses as an array's text or alone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    docs = F.array(F.lit(" "), F.col("event_type"), F.col("props"), F.lit('{"k": 0}'), F.lit("last"))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    urls = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(user, F.lit(" "), F.lit("b")))).otherwise(user)
    return e.select("event_id", markdown.first_of("json", docs).alias("json_doc"), markdown.first_of("text", docs).alias("text_doc"), F.array_join(markdown.url_list(urls), "|").alias("urls"))


@R.add("link_context", r"SELECT conv_id, turn, 'one' || chr(10) || lang || chr(10) || 'two' AS near FROM (SELECT conv_id, turn, coalesce(role, '') AS lang FROM conversations) t")
def link_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines around a posting's link, other link lines left out."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.concat(F.lit("far\nfar\none\n[b](x)\n"), F.coalesce("role", F.lit("")), F.lit("\n[c](y)\n[job](/jobs/"), F.col("conv_id").cast("string"), F.lit(")\ntwo\n[d](z)\n[e](z)\n[f](z)\nfar"))
    needle = F.concat(F.lit("/jobs/"), F.col("conv_id").cast("string"), F.lit(")"))
    return c.select("conv_id", "turn", F.array_join(markdown.line_around(body, needle), "\n").alias("near"))
