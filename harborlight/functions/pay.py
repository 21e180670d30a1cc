"""Pay, currency and level expressions. The store and the ingest layer differ in places; both forms are kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import col, contains_any, lookup, lower, trim

# Bounds of a plausible annual pay, and hours of a working year.
NO_PAY_REASON = "pending markdown structured extraction"
LEAST_PAY, MOST_PAY, YEAR_HOURS = 30_000, 5_000_000, 2080
LEVELS = ["junior", "mid", "senior", "staff"]
# Currencies that have a sign of their own in American English.
CURRENCY_SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥", "CAD": "CA$", "AUD": "A$", "NZD": "NZ$", "MXN": "MX$", "BRL": "R$", "CNY": "CN¥", "KRW": "₩", "ILS": "₪", "VND": "₫", "TWD": "NT$", "HKD": "HK$", "PHP": "₱"}


def usd(c: Column | str) -> Column:
    return F.when(F.upper(trim(col(c))).isin("USD", "US$", "$", "USD$"), "USD")


def bounded_pay(c: Column | str) -> Column:
    v = F.floor(col(c)).cast("long")
    return F.when((v > LEAST_PAY) & (v < MOST_PAY), v)


def numbers_in(c: Column | str) -> Column:
    """Numbers of a text, thousands separators dropped."""
    found = F.regexp_extract_all(F.replace(col(c), F.lit("\u00a0"), F.lit(" ")), F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.try_to_number(F.replace(x, F.lit(","), F.lit("")), F.lit("999999999999999.999999")).cast("double"))


def pay_from_field(c: Column | str) -> Column:
    """Store layer: the largest number of the field, without bounds; null if none."""
    m = F.array_max(numbers_in(c))
    return F.when(m > 0, m)


def pay_from_text(c: Column | str) -> Column:
    """Ingest layer: the largest number within bounds, retirement plans (401k) not counted; 0 for unknown."""
    plan = r"(?i)\b40[13]\s*\(?[kb]\)?"
    m = F.array_max(numbers_in(F.regexp_replace(col(c), plan, " ")))
    return F.coalesce(bounded_pay(m), F.lit(0).cast("long"))


def hint_pay(c: Column | str) -> Column:
    """Store layer's reading of a description: midpoint of the extremes of all dollar values of at least 10,000."""
    found = F.regexp_extract_all(col(c), F.lit(r"\$\s*([0-9][0-9,]*)(k|K)?"), F.lit(0))
    values = F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "").cast("double") * F.when(F.lower(x).endswith("k"), 1000).otherwise(1))
    good = F.filter(values, lambda v: v >= 10_000)
    return F.floor((F.array_min(good) + F.array_max(good)) / 2).cast("long")


def hourly_to_annual(c: Column | str) -> Column:
    return (col(c) * YEAR_HOURS).cast("long")


def midpoint(low: Column, high: Column) -> Column:
    """Midpoint of two plausible bounds, or the one that is plausible."""
    a, b = bounded_pay(low), bounded_pay(high)
    return F.coalesce(F.floor((a + b) / 2).cast("long"), a, b)


def currency_code(c: Column | str) -> Column:
    """The first currency that a text names, in fixed order."""
    t = F.upper(col(c))
    return (
        F.when(t.rlike(r"₹|\bINR\b|\bLPA\b|\bLAKHS?\b"), "INR")
        .when(t.rlike(r"£|\bGBP\b"), "GBP")
        .when(t.rlike(r"€|\bEUR\b"), "EUR")
        .when(t.rlike(r"\bAUD\b|A\$"), "AUD")
        .when(t.rlike(r"\bCAD\b|C\$"), "CAD")
        .when(t.rlike(r"\$|\bUSD\b"), "USD")
    )


def parse_pay_input(c: Column | str, most: int = 1_000_000) -> Column:
    """"$150k" as typed into a form; clamped."""
    t = F.regexp_replace(lower(col(c)), r"[\s$,]", "")
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)k?$", 1)
    v = F.when(n != "", n.cast("double") * F.when(t.endswith("k"), 1000).otherwise(1))
    return F.when(v.isNotNull(), F.least(F.round(v).cast("long"), F.lit(most).cast("long")))


def display_pay(c: Column | str) -> Column:
    return F.concat(F.lit("$"), F.round(col(c) / 1000).cast("long").cast("string"), F.lit("k"))


def money(c: Column | str, code: Column | str) -> Column:
    """Whole units with the currency's sign, or with its code where no sign is listed; null pay is "Unknown", a code that is none counts as USD."""
    known = F.coalesce(F.upper(col(code)), F.lit(""))
    code_of = F.when(known.rlike("^[A-Z]{3}$"), known).otherwise("USD")
    sign = F.coalesce(lookup(code_of, CURRENCY_SIGNS), F.concat(code_of, F.lit("\u00a0")))
    v = F.floor(F.abs(col(c)) + 0.5).cast("long")
    return F.coalesce(F.concat(F.when((col(c) < 0) & (v > 0), "-").otherwise(""), sign, F.format_number(v, 0)), F.lit("Unknown"))


def round_pay(c: Column | str, step: int = 1000) -> Column:
    """To the step, halves to the even one."""
    return (F.bround(col(c) / step) * step).cast("long")


def level_from_hint(c: Column | str) -> Column:
    """Store layer: leaders are staff, managers mid."""
    h = lower(F.coalesce(col(c), F.lit("")))
    return (
        F.when(contains_any(h, ["intern", "junior"]), "junior")
        .when(contains_any(h, ["staff", "principal", "lead", "director", "vp", "chief"]), "staff")
        .when(h.contains("senior") | (h == "sr"), "senior")
        .otherwise("mid")
    )


def level_at_ingest(value: Column | str, title: Column | str) -> Column:
    """Ingest layer: leaders and managers are senior; the title decides where no level is given."""
    v = lower(F.coalesce(col(value), F.lit("")))
    m = F.when(v != "", v).otherwise(lower(F.coalesce(col(title), F.lit(""))))
    return (
        F.when(contains_any(m, ["staff", "principal"]), "staff")
        .when(contains_any(m, ["senior", "sr ", "sr.", "sr-", "sr/", "lead", "manager", "director", "vp", "chief", "head"]), "senior")
        .when(contains_any(m, ["intern", "jr", "junior"]), "junior")
        .otherwise("mid")
    )


def remote_at_store(value: Column, location: Column, title: Column) -> Column:
    said = lower(F.coalesce(value, F.lit(""))).isin("true", "yes", "1", "remote", "hybrid", "fully remote")
    return said | lower(F.coalesce(location, F.lit(""))).contains("remote") | lower(F.coalesce(title, F.lit(""))).contains("remote")


def remote_at_ingest(value: Column, location: Column, title: Column) -> Column:
    """A known place that is not remote forces false."""
    said = lower(F.coalesce(value, F.lit(""))).isin("true", "yes", "remote", "hybrid", "fully remote")
    loc = lower(F.coalesce(location, F.lit("")))
    placed = (loc != "") & (loc != "unknown") & ~loc.contains("remote")
    return F.when(said, True).when(placed, False).otherwise(loc.contains("remote") | lower(F.coalesce(title, F.lit(""))).contains("remote"))


def cost_milli_cents(usd_cost: Column) -> Column:
    return F.round(usd_cost * 100_000).cast("long")


def even_cost(cost: Column, rows: Column) -> Column:
    return F.floor(cost / F.greatest(rows, F.lit(1))).cast("long")
