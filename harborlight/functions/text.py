"""Text expressions: every function takes and returns Columns, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import any_of, col, contains_any, let, lower, squeeze, trim

# Labels that stand for a missing value, and titles that stand for none.
UNKNOWN_LABELS = ["", "unknown", "n/a", "na", "unspecified", "not available"]
TITLE_PLACEHOLDERS = ["page_title", "title", "job_title", "untitled", "application"]
NOISY_TITLE_PHRASES = ["apply with ai", "direct apply", "select an option", "automated source picker"]
LISTING_PHRASES = ["job openings", "jobs at", "careers at", "all locations", "all teams", "view openings", "open positions", "open roles"]
LISTING_MARKERS = [
    "open positions", "open position", "search for opportunities", "search for jobs", "search jobs", "select department", "select country",
    "select location", "select city", "select state", "select category", "search category", "all locations", "all teams", "all roles",
    "all types", "view openings", "available in multiple locations", "job fairs", "work programs", "view all jobs", "filter by",
]
DETAIL_MARKERS = [
    "responsibilities", "requirements", "qualifications", "what you'll do", "what you will do", "about the role", "about the position",
    "who you are", "benefits", "compensation", "salary", "equal opportunity",
]
ERROR_PHRASES = [
    "page not found", "job not found", "posting not found", "we can't find what you're looking for", "we can\u2019t find what you're looking for",
    "could not find what you're looking for", "couldn't find what you're looking for", "no longer available", "no longer accepting applications",
    "no longer taking applications", "position has been filled", "position filled", "job has been filled", "job posting has expired",
    "posting has expired", "job has expired", "job is closed", "posting is closed",
]
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
CAPTCHA_MARKERS = ["captcha", "verify you are human", "are you a robot", "checking your browser", "access denied"]


def is_unknown_label(c: Column | str) -> Column:
    """True for null, blank and the words that mean a missing value."""
    return lower(trim(F.coalesce(col(c), F.lit("")))).isin(UNKNOWN_LABELS)


def is_unknown_title(c: Column | str) -> Column:
    return is_unknown_label(c) | lower(trim(col(c))).isin(TITLE_PLACEHOLDERS)


def engineer_flag(title: Column | str) -> Column:
    """Unknown titles count as engineering; others need the word."""
    return is_unknown_title(title) | lower(col(title)).contains("engineer")


def slug(c: Column | str) -> Column:
    """Kebab slug; "unknown" when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def title_case(c: Column | str) -> Column:
    """ASCII words, the first letter of each raised and the rest as it is."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def decode_entities(c: Column | str) -> Column:
    """The six common entities, in fixed order: a doubly escaped one is decoded twice."""
    out = col(c)
    for name, char in ENTITIES:
        out = F.regexp_replace(out, f"(?i){name}", char.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def strip_html(c: Column | str) -> Column:
    """Scripts, styles and tags to spaces, then entities decoded."""
    out = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))


def clean_scraped(c: Column | str) -> Column:
    return F.coalesce(trim(squeeze(strip_html(c))), F.lit(""))


def truncate_words(c: Column | str, most: int = 220) -> Column:
    """At most so many characters, cut at a word and closed with three dots."""
    whole = trim(squeeze(F.coalesce(col(c), F.lit(""))))
    cut = F.rtrim(F.substring(whole, 1, max(0, most - 3)))
    base = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.when(base == "", cut).otherwise(base), F.lit("...")))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"[^\x20\x09-\x0D]+"))


def is_noisy_title(c: Column | str) -> Column:
    """Placeholders, interface phrases, addresses and long calls to apply."""
    t = trim(F.coalesce(col(c), F.lit("")))
    low = lower(t)
    placeholder = low.isin([*TITLE_PLACEHOLDERS, "unknown", ""])
    long_call = (word_count(t) >= 8) & (low.contains("posted") | low.contains("apply"))
    return placeholder | contains_any(low, NOISY_TITLE_PHRASES) | t.rlike(r"(?i)https?://") | t.rlike(r"\\{3,}|/{6,}") | long_call


def listing_title(c: Column | str) -> Column:
    """A cleaned title of a listing row, without its employer or place suffix; null if it is no title."""
    t = clean_scraped(c)
    t = F.regexp_replace(t, r"^(.+?)\s+@\s+.+$", "$1")
    tail = F.regexp_extract(t, r"^.+?\s+[-\u2013\u2014]\s+(.+)$", 1)
    place = tail.rlike(r"(?i)\b(remote|hybrid|on[- ]?site|anywhere|usa|us|uk|eu|emea|apac|latam|inc|llc|ltd|corp|co|company|plc|gmbh|sarl|pte|pty)\b") | tail.rlike(r"[A-Za-z .'-]+,\s*[A-Z]{2}\b")
    t = F.when((tail != "") & place, trim(F.regexp_replace(t, r"^(.+?)\s+[-\u2013\u2014]\s+.+$", "$1"))).otherwise(t)
    return F.when(~is_noisy_title(t) & (F.length(t) <= 140) & (word_count(t) >= 2), t)


def capped_title(c: Column | str) -> Column:
    """A clean title cut to 140 characters; "Untitled" when blank."""
    t = col(c)
    return F.when(t == "", "Untitled").when(F.length(t) > 140, F.concat(F.rtrim(F.substring(t, 1, 137)), F.lit("..."))).otherwise(t)


def normal_title(c: Column | str) -> Column:
    """Clean title of at most 140 characters; "Untitled" when blank."""
    return capped_title(clean_scraped(c))


def is_uuid_like(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\s-]", "").rlike("(?i)^[0-9a-f]{32}$")


def is_numeric_id(c: Column | str) -> Column:
    return col(c).rlike(r"^\d{3,}$")


def sentence_like(c: Column | str) -> Column:
    """Fifteen words, or eight and a closing mark."""
    n = word_count(c)
    return (n >= 15) | ((n >= 8) & trim(col(c)).rlike(r"[.!?]$"))


def is_listing_text(title: Column | str, body: Column | str) -> Column:
    both = lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(body), F.lit(""))))
    return contains_any(both, LISTING_PHRASES)


def sample_of(title: Column | str, body: Column | str, most: int) -> Column:
    return F.substring(squeeze(lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(body), F.lit(""))))), 1, most)


def is_error_landing(title: Column | str, body: Column | str) -> Column:
    """404 or a phrase of a closed posting near the top of title and body."""
    s = sample_of(title, body, 700)
    return s.rlike(r"\b404\b") | contains_any(s, ERROR_PHRASES)


def marker_hits(sample: Column, markers: list[str]) -> Column:
    return sum((sample.contains(m).cast("int") for m in markers), F.lit(0))


def is_listing_page(title: Column | str, body: Column | str) -> Column:
    """A listing or filter page rather than one job, by weighted counts of markers, selects and links."""
    s = sample_of(title, body, 2000)
    marks, selects = marker_hits(s, LISTING_MARKERS), F.regexp_count(s, F.lit(r"\bselect\b"))
    links = (F.length(col(body)) - F.length(F.replace(col(body), F.lit("]("), F.lit("")))) / 2
    found = any_of(
        s.contains("open positions") & (s.contains("search for opportunities") | (selects >= 1)),
        marks >= 4,
        (marks >= 3) & (selects >= 1),
        (selects >= 3) & (marks >= 1),
        (links >= 8) & (marks >= 2),
    )
    return F.coalesce((F.length(col(body)) > 0) & found, F.lit(False))


def captcha_marker(c: Column | str) -> Column:
    """The first marker of a bot check that the text holds; null if none."""
    low = lower(col(c))
    return F.coalesce(*(F.when(low.contains(m), m) for m in CAPTCHA_MARKERS))


def has_required_keyword(title: Column | str, keywords: list[str], allow_missing: bool = True) -> Column:
    """Any keyword as a substring, whatever its case; a blank title passes by setting, and an empty list passes all."""
    t = col(title)
    if not keywords:
        return F.lit(True)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(allow_missing)).otherwise(contains_any(lower(t), [k.lower() for k in keywords]))


def distinct_in_order(c: Column) -> Column:
    """Trimmed, case-blind distinct values in order, without blanks and "unknown".

    Sorted by spelling to meet their repeats and back by place, so that long lists cost no pairs.
    """
    clean = F.filter(F.transform(c, lambda x: trim(F.coalesce(x, F.lit("")))), lambda x: (x != "") & (F.lower(x) != "unknown"))
    keyed = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = let(keyed, lambda s: F.filter(s, lambda e, i: (i == 0) | (e["k"] != F.get(s, i - 1)["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def mask_secret(c: Column | str) -> Column:
    s = col(c)
    return F.when(s.isNull(), F.lit(None)).when(F.length(s) <= 8, "***").otherwise(F.concat(F.substring(s, 1, 4), F.lit("..."), F.substring(s, -4, 4)))


def shrink(c: Column | str, most: int) -> Column:
    """Cuts a long text and says by how many characters."""
    s = col(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("... (+"), (F.length(s) - most).cast("string"), F.lit(" chars)")))


def phrase_in(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text bounded by spaces or its ends."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))

