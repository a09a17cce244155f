"""Small helpers of the functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE = 2**53 - 1


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c) -> Column:
    """Halves go up."""
    return F.floor(col(c) + 0.5)


def instant(c) -> Column:
    """An ISO-8601 text as a timestamp; null where it can't be read."""
    return F.try_to_timestamp(col(c))


def iso(ts) -> Column:
    """A timestamp as ISO-8601 with milliseconds in UTC (the session's time zone must be UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def safe_integer(c) -> Column:
    """A count or size in 0 .. 2**53 - 1 as long; null outside."""
    v = col(c).try_cast("long")
    return F.when(v.between(0, MAX_SAFE), v)


def require_safe_integer(c) -> Column:
    """The same, but values outside fail the query."""
    v = col(c).cast("long")
    return F.when(v.isNull() | v.between(0, MAX_SAFE), v).otherwise(F.raise_error(F.lit("integer outside 0 .. 2^53 - 1")))


def safe_capacity(text) -> Column:
    """A capacity given as digits; null otherwise."""
    t = col(text).cast("string")
    return F.when(t.rlike(r"^\d+$"), safe_integer(t))


def boolean_fact(text) -> Column:
    t = col(text).cast("string")
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)


def non_empty(text) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(col(text), r"^\s+|\s+$", "")), F.lit(""))
