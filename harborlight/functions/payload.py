"""JSON payload expressions: payloads are JSON text at rest and VARIANT in memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import col, trim

# Spellings under which payload rows keep a field.
TITLE_KEYS = ["title", "job_title", "jobTitle", "name", "position", "role", "heading", "text", "label", "posting_title", "postingTitle"]
URL_KEYS = ["url", "link", "href", "absolute_url"]
APPLY_KEYS = ["apply_url", "applyUrl", "company_url", "companyUrl", "absolute_apply_url", "absoluteApplyUrl", "absolute_url", "absoluteUrl", "job_url", "jobUrl", "url", "link", "href", "_url"]
BODY_KEYS = ["description", "job_description", "desc", "body", "summary", "content"]
BATCH_KEYS = ["batchId", "batch_id", "jobId", "job_id", "id", "requestId"]
ROW_PATHS = ["$", "$.normalized", "$.items", "$.results", "$.results.items", "$.raw.items"]
SECRET_HEADERS = ["authorization", "cookie", "x-api-key", "api-key", "set-cookie"]


def variant(c: Column | str) -> Column:
    """VARIANT of a JSON text; null where it is malformed."""
    return F.try_parse_json(col(c))


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def first_text(v: Column, keys: list[str]) -> Column:
    """The first non-blank text among some spellings of a field."""
    return F.coalesce(*(F.nullif(trim(get(v, f"$.{k}")), F.lit("")) for k in keys))


def number(v: Column, path: str) -> Column:
    """A number, also where it is written as text with separators."""
    return F.coalesce(get(v, path, "double"), F.replace(get(v, path), F.lit(","), F.lit("")).try_cast("double"))


def payload_rows(v: Column) -> Column:
    """All rows of a payload, from each place that may hold an array, in fixed order."""
    return F.flatten(F.array(*(F.coalesce(get(v, p, "array<variant>"), F.array().cast("array<variant>")) for p in ROW_PATHS)))


def first_array(v: Column, paths: list[str]) -> Column:
    return F.coalesce(*(get(v, p, "array<variant>") for p in paths))


def count_rows(v: Column) -> Column:
    """Size of the payload's first array; 1 for another object, 0 for none."""
    return F.coalesce(F.size(first_array(v, ["$.normalized", "$.results.items", "$.items", "$.results", "$"])), F.when(v.isNotNull(), 1), F.lit(0))


def pay_range(v: Column) -> Column:
    """The larger bound of a range object, else the smaller."""
    big, small = F.coalesce(number(v, "$.max_value"), number(v, "$.max")), F.coalesce(number(v, "$.min_value"), number(v, "$.min"))
    return F.coalesce(F.when(big > 0, big), F.when(small > 0, small))


def string_leaves(c: Column | str) -> Column:
    """All string values of a JSON text, in order of appearance; keys are not values."""
    hit = F.regexp_extract_all(col(c), F.lit(r'("(?:[^"\\]|\\.)*"(?:\s*:)?)'), F.lit(1))
    values = F.filter(hit, lambda s: s.endswith('"'))
    return F.transform(values, lambda s: F.regexp_replace(F.regexp_replace(s.substr(F.lit(2), F.length(s) - 2), r"\\/", "/"), r'\\"', '"'))


def links_in(c: Column | str) -> Column:
    """Distinct addresses of a text, closing punctuation dropped."""
    found = F.regexp_extract_all(col(c), F.lit(r"""(https?://[^\s"'<>\\)\]]+)"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;]+$", "")))


def job_links(c: Column | str) -> Column:
    return F.filter(links_in(c), lambda u: F.lower(u).rlike(r"job|career|position|opening|requisition|greenhouse|ashby|workday"))


def markdown_links(c: Column | str) -> Column:
    """struct(title, url) of every [title](url)."""
    hit = F.regexp_extract_all(col(c), F.lit(r"(\[[^\]\n]+\]\([^)\s]+\))"), F.lit(1))
    return F.transform(hit, lambda m: F.struct(F.regexp_extract(m, r"^\[([^\]]+)\]", 1).alias("title"), F.regexp_extract(m, r"\(([^)\s]+)\)$", 1).alias("url")))


def anchors(c: Column | str) -> Column:
    """struct(url, title) of every anchor of an html text."""
    hit = F.regexp_extract_all(col(c), F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(hit, lambda a: F.struct(F.regexp_extract(a, r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1).alias("url"), trim(F.regexp_replace(a, r"<[^>]+>", " ")).alias("title")))


def max_number_under(c: Column | str, word: str) -> Column:
    """The largest number whose key holds the word, at any depth."""
    hit = F.regexp_extract_all(col(c), F.lit(rf'(?i)"[^"]*{word}[^"]*"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)'), F.lit(1))
    return F.array_max(F.transform(hit, lambda x: x.cast("double")))


def redact_headers(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(SECRET_HEADERS), "***").otherwise(v))


def drop_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


JOB_POSTING = (
    "title string, datePosted string, hiringOrganization struct<name string>, jobLocation struct<address struct<addressLocality string, addressRegion string, addressCountry string>>, description string"
)
BOARD = "jobs array<struct<absolute_url string, id long, title string, updated_at string, first_published string, location struct<name string>, content string>>"


def job_posting(html: Column | str) -> Column:
    """The JSON-LD posting of a page as a struct; null without one."""
    block = F.regexp_extract(col(html), r"""(?is)<script[^>]*application/ld\+json[^>]*>\s*(\{.*?"JobPosting".*?\})\s*</script>""", 1)
    return F.when(block != "", F.from_json(block, JOB_POSTING))


def board_jobs(text: Column | str) -> Column:
    """Jobs of a board listing; a byte-order mark and text around the object are tolerated."""
    return F.from_json(F.regexp_extract(col(text), r"(?s)(\{.*\})", 1), BOARD)["jobs"]
