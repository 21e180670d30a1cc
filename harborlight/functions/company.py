"""Company names: keys, suffixes, display spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import col, lower, trim
from harborlight.functions.text import is_unknown_label
from harborlight.functions.url import company_from_url

# Legal suffixes as the store and the ingest layer know them.
STORE_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "ltd", "limited", "plc"]
INGEST_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "co", "plc", "gmbh", "sarl", "ag", "bv", "sa", "pte", "pty", "holdings", "group"]
GENERIC_NAMES = ["", "unknown", "job board", "jobs", "careers", "greenhouse", "ashby", "workday"]


def _words(c: Column | str) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(lower(F.coalesce(col(c), F.lit(""))), "['’]", ""), "[^a-z0-9]+", " "))


def filter_key(c: Column | str) -> Column:
    """Lower-cased name without closing legal suffixes, spelt-out ones included, joined without spaces."""
    spelt = [" ".join(s) for s in STORE_SUFFIXES if len(s) in (2, 3)]
    tail = "|".join([*STORE_SUFFIXES, *spelt])
    return F.regexp_replace(F.regexp_replace(_words(c), f"(?<=[a-z0-9])( ({tail}))+$", ""), " ", "")


def company_key(c: Column | str) -> Column:
    k = filter_key(c)
    return F.when(k != "", k).otherwise(lower(trim(F.coalesce(col(c), F.lit("")))))


def ingest_name(c: Column | str) -> Column:
    """The ingest layer's key: more suffixes, words kept apart."""
    return F.regexp_replace(_words(c), "(?<=[a-z0-9])( (" + "|".join(INGEST_SUFFIXES) + "))+$", "")


def alnum_key(c: Column | str) -> Column:
    return F.regexp_replace(lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]", "")


def is_version_label(c: Column | str) -> Column:
    return trim(F.coalesce(col(c), F.lit(""))).rlike(r"(?i)^v\d+$")


def should_override(c: Column | str) -> Column:
    """Names that carry no company: unknown, a provider's, a version label."""
    return is_unknown_label(c) | (trim(col(c)) == "Greenhouse") | is_version_label(c) | (alnum_key(c) == "ashbyhq")


def is_generic(c: Column | str) -> Column:
    return lower(trim(F.coalesce(col(c), F.lit("")))).isin(GENERIC_NAMES)


def resolve_company(alias: Column, site: Column, current: Column, url: Column) -> Column:
    """Domain alias, then the site's name, then a safe current name, then the address."""
    known = lambda c: F.when(~is_unknown_label(c), trim(c))
    return F.coalesce(known(alias), known(site), F.when(~should_override(current), trim(current)), F.nullif(company_from_url(url), F.lit("")), F.lit("Site"))


def display_rank(c: Column | str) -> Column:
    """Ordering of spellings: a raised first letter, then any capital, then more of them, then shorter."""
    n = trim(col(c))
    caps = F.regexp_count(n, F.lit("[A-Z]"))
    return F.struct(n.rlike("^[A-Z]").cast("int").alias("first"), (caps > 0).cast("int").alias("any"), caps.alias("caps"), (-F.length(n)).alias("short"), lower(n).alias("name"))


def is_remote_company(c: Column | str, remote: list[str]) -> Column:
    k = ingest_name(c)
    return (k != "") & k.isin(remote)
