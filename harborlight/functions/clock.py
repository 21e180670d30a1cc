"""Time expressions. Instants are epoch milliseconds, and the clock is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import col, trim

DAY_MS, HOUR_MS, MINUTE_MS = 86_400_000, 3_600_000, 60_000
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def ms(ts: Column | str) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def clock_minutes(c: Column | str) -> Column:
    """"HH:MM" as minutes of the day, clamped; 0 for anything else."""
    hh, mm = (F.regexp_extract(F.coalesce(col(c), F.lit("")), r"^(\d{2}):(\d{2})$", i) for i in (1, 2))
    return F.when(hh == "", 0).otherwise(F.least(hh.cast("int"), F.lit(23)) * 60 + F.least(mm.cast("int"), F.lit(59)))


def latest_slot(now_ms: Column, days: Column, start: Column, interval: Column, zone: Column | str) -> Column:
    """The last open slot of today in the schedule's zone; null on another day or before the start."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    local = F.convert_timezone(F.lit("UTC"), z, F.timestamp_millis(now_ms).cast("timestamp_ntz"))
    day = F.lower(F.date_format(local, "E"))
    minute = F.hour(local) * 60 + F.minute(local)
    first, step = clock_minutes(start), F.greatest(F.coalesce(interval, F.lit(1440)).cast("int"), F.lit(1))
    at = first + F.floor((minute - first) / step) * step
    midnight = F.convert_timezone(z, F.lit("UTC"), F.date_trunc("day", local).cast("timestamp_ntz"))
    return F.when(F.array_contains(days, day) & (minute >= first), ms(midnight) + at.cast("long") * MINUTE_MS)


def posted_at(value: Column | str, now_ms: Column) -> Column:
    """struct(ms, unknown): epoch seconds or milliseconds, or an ISO instant; else now and unknown."""
    v = trim(col(value).cast("string"))
    n = v.try_cast("double")
    iso = F.unix_millis(F.regexp_replace(v, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    found = F.when(n > 1e12, n.cast("long")).when(n > 1e9, (n * 1000).cast("long")).when(n.isNull(), iso)
    return F.struct(F.coalesce(found, now_ms).alias("ms"), found.isNull().alias("unknown"))


def elapsed(created: Column, completed: Column, updated: Column, now_ms: Column) -> Column:
    return F.greatest(F.coalesce(completed, updated, now_ms) - created, F.lit(0).cast("long"))


def scheduled_default(created: Column, updated: Column, now_ms: Column) -> Column:
    return F.coalesce(created, updated, now_ms)
