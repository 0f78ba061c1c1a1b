"""Scalar helpers whose behaviour differs from Spark's built-ins: zero-based slices, lenient concatenation and the like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr0(s: Column, start: int, length: int | None = None) -> Column:
    """Substring by a zero-based start."""
    return F.substring(s, F.lit(start + 1), F.lit(length) if length is not None else F.length(s))


def strip(s: Column) -> Column:
    """All white space at both ends goes, not blanks alone."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def concat_lenient(*cols: Column) -> Column:
    """Nulls count as empty texts."""
    return F.concat_ws("", *[c.cast("string") for c in cols])


def length_of(x: Column) -> Column:
    return F.length(x.cast("string"))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def days_between(a: Column, b: Column) -> Column:
    """Whole periods of 24 hours from b to a, rounded down."""
    sec = F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))
    return F.floor(sec / 86400)


def sum0(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a, b)


def cast_or_null(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


def matches_pattern(x: Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return x.ilike(pattern)


#: Comparisons by name, as pattern conditions use them.
PREDICATES = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v),
    "regex": lambda c, v: c.rlike(f"^(?:{v})"),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
}


def condition(field: str, op: str, value, negate: bool = False) -> Column:
    if op not in PREDICATES:
        raise ValueError(f"unknown comparison {op}")
    got = PREDICATES[op](F.col(field), value)
    return ~got if negate else got
