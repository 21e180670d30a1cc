"""Crawl queries: addresses, page text, links, URL sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.bindings import oracle, shape
from harborlight.functions import payload, text, url
from harborlight.operators import merge, queue, rollups
from harborlight.plans.registry import Registry

R = Registry()
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.add("url_parts", f"""
SELECT page_id, {_HOST} AS host, {_PATH} AS path, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query, array_to_string(string_split({_HOST}, '.')[-2:], '.') AS base_domain, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) AS n_segments FROM pages""")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(
        "page_id", url.host("url").alias("host"), url.path("url").alias("path"), url.query("url").alias("query"), url.base_domain(url.host("url")).alias("base_domain"), F.size(url.segments("url")).cast("long").alias("n_segments")
    )


@R.add("url_canonical", f"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS job_url, regexp_replace(url, '/+$', '') AS url_key,
  'general:' || lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS site_key
FROM (SELECT *, regexp_replace({_PATH}, '/+$', '') AS p FROM pages)""")  # fmt: skip
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", url.job_url("url").alias("job_url"), url.url_key("url").alias("url_key"), url.site_key("url", F.lit(None).cast("string")).alias("site_key"))


@R.add("url_company", f"""
SELECT page_id, upper(substr(n, 1, 1)) || substr(n, 2) AS company, n AS site_name FROM (SELECT page_id, string_split({_HOST}, '.')[-2] AS n FROM pages)""")  # fmt: skip
def url_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", url.company_from_url("url").alias("company"), url.site_name("url").alias("site_name"))


@R.add("url_tests", f"""
SELECT page_id, regexp_matches(string_split(url, '?')[1], '(?i)/(jobs|careers|openings|job-openings|all-jobs|positions|opportunities)/?$') AS listing, CASE WHEN contains({_HOST}, 'greenhouse.io') THEN 1 ELSE 2 END AS apply_score,
  starts_with(url, 'https://blog.') AS fits_pattern, false AS auth FROM pages""")  # fmt: skip
def url_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", url.is_listing_url("url").alias("listing"), url.apply_url_score("url").alias("apply_score"), url.matches_pattern("url", "https://blog.**").alias("fits_pattern"), url.is_auth_url("url").alias("auth"))


@R.add("url_titles", f"""
SELECT page_id, CASE WHEN regexp_matches(s, '^\\d{{3,}}$') OR regexp_matches(replace(s, ' ', ''), '(?i)^[0-9a-f]{{32}}$') THEN NULL ELSE s END AS title FROM (
  SELECT page_id, trim(regexp_replace(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1], '[-_]+', ' ', 'g')) AS s FROM pages)""")  # fmt: skip
def url_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", url.title_from_url("url").alias("title"))


@R.add("existing_urls", """
SELECT DISTINCT p.url FROM pages p WHERE EXISTS (SELECT 1 FROM (SELECT url FROM pages WHERE page_id % 3 = 0) j WHERE j.url = p.url OR j.url = regexp_replace(p.url, '/+$', '') OR j.url = p.canon OR j.url = regexp_replace(p.canon, '/+$', ''))""".replace(
    "FROM pages p WHERE", f"FROM (SELECT url, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN p0 = '' THEN '/' ELSE p0 END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS canon FROM (SELECT url, regexp_replace({_PATH}, '/+$', '') AS p0 FROM pages)) p WHERE"))
def existing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses are stored under any of their spellings; the stored table here is every third page."""
    pages = _table(spark, sf_dir, "pages")
    stored = pages.where("page_id % 3 = 0").select(F.col("url").alias("spelling")).distinct()
    return queue.spelt(pages).join(stored, "spelling", "left_semi").select("url").distinct()


@R.add("urls_to_scrape", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def urls_to_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference that keeps the order and the repeats of the left side."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 5 = 0").select("url").distinct(), "url", "left_anti").orderBy("page_id")


@R.add("seen_urls_union", "SELECT url FROM pages WHERE starts_with(url, 'http://') UNION SELECT url FROM pages WHERE starts_with(url, 'https://m.')")
def seen_urls_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.where(url.matches_pattern("url", "http://*")).select("url").union(pages.where(url.matches_pattern("url", "https://m.*")).select("url")).distinct()


@R.add("first_row_per_url", "SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages WHERE page_id % 2 = 1) WHERE n = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def first_row_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return merge.insert_absent(pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1"), ["url"], [F.col("page_id")]).select("page_id", "url")


@R.add("page_titles", f"SELECT page_id, {_TITLE} AS title, length({_TITLE}) AS n, len(regexp_extract_all({_TITLE}, '[^\\x20\\x09-\\x0D]+')) AS n_words FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(title).cast("long").alias("n"), text.word_count(title).cast("long").alias("n_words"))


@R.add("page_anchors", "SELECT page_id, regexp_extract(a, '(?i)href\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1) AS href, trim(regexp_replace(a, '<[^>]+>', ' ', 'g')) AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\\b[^>]*>.*?</a>)', 1)) AS a FROM pages)")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(payload.anchors("html")).alias("a")).select("page_id", F.col("a.url").alias("href"), F.col("a.title").alias("title"))


@R.add("page_text", """
SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g')) AS t FROM pages)""")  # fmt: skip
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.clean_scraped("html")
    return _table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@R.add("document_gate", """
SELECT doc_id, contains(lower(text), 'engineer') OR contains(lower(text), 'tion') AS keyword, regexp_matches(substr(regexp_replace(lower(' ' || text), '\\s+', ' ', 'g'), 1, 700), '\\b404\\b') AS error_page, contains(lower(text), 'captcha') AS captcha FROM documents""")  # fmt: skip
def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.has_required_keyword("text", ["engineer", "tion"]).alias("keyword"), text.is_error_landing(F.lit(""), F.col("text")).alias("error_page"), (text.captcha_marker("text") == "captcha").eqNullSafe(True).alias("captcha"))


@R.add("document_excerpt", """
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE CASE WHEN regexp_replace(c, '\\s+\\S*$', '') = '' THEN c ELSE regexp_replace(c, '\\s+\\S*$', '') END || '...' END AS excerpt
FROM (SELECT doc_id, t, rtrim(substr(t, 1, 237)) AS c FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents))""")  # fmt: skip
def document_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate_words("text", 240).alias("excerpt"))


@R.add("document_pay", """
SELECT doc_id, coalesce((SELECT max(v) FROM (SELECT floor(m)::BIGINT AS v) WHERE v > 30000 AND v < 5000000), 0) AS pay FROM (
  SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE))) AS m FROM documents)""")  # fmt: skip
def document_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harborlight.functions import pay

    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(pay.bounded_pay(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")))), F.lit(0)).alias("pay"))


@R.add("document_links", "SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '(https?://[^\\s\"''<>\\\\)\\]]+)', 1), lambda u: regexp_replace(u, '[.,;]+$', '')))) AS n_links FROM documents")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(payload.links_in("text")).cast("long").alias("n_links"))


@R.add("domain_top_pages", f"SELECT host, page_id, n AS rank FROM (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY length(html) DESC, page_id) AS n FROM pages) WHERE n <= 3")
def domain_top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", url.host("url").alias("host"), F.length("html").alias("size"))
    return rollups.ranked(pages, ["host"], [F.desc("size"), F.col("page_id")], 3).select("host", "page_id", "rank")


@R.add("quality_join", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def quality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").fillna(-1, ["quality"])
