"""Small helpers that every group of expressions uses."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c: Column | str) -> Column:
    return F.lower(col(c))


def trim(c: Column | str) -> Column:
    """Strips all Unicode white space, which Spark's own trim does not."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+", " ")


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of(*(c.contains(w) for w in words)) if words else F.lit(False)


def regex_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a fixed map; null for other keys. The map is one folded literal, not a node an entry."""
    text = ";".join(f"{k}={v}" for k, v in values.items())
    return F.element_at(F.str_to_map(F.lit(text), F.lit(";"), F.lit("=")), key)


def truthy(c: Column | str) -> Column:
    """Null counts as false."""
    return F.coalesce(col(c), F.lit(False))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also inside functions of arrays, where equal parts are not shared."""
    return F.get(F.transform(F.array(value), f), 0)
