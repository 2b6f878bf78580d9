"""Valid-time predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(at: datetime | str | Column) -> Column:
    if isinstance(at, Column):
        return at
    return F.lit(at.isoformat(sep=" ") if isinstance(at, datetime) else at).cast("timestamp_ntz")


def as_of(at: datetime | str | Column, closed: bool = True) -> Column:
    """Valid at an instant. closed: valid_to itself counts, as it does for nodes and doesn't for edges."""
    t = instant(at)
    end = F.col("valid_to") >= t if closed else F.col("valid_to") > t
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | end)


def between(start: datetime | str, end: datetime | str) -> Column:
    """Began or ended within a range."""
    a, b = instant(start), instant(end)
    return F.col("valid_from").between(a, b) | F.coalesce(F.col("valid_to").between(a, b), F.lit(False))


def seconds_between(start: Column, end: Column) -> Column:
    """Exact to the microsecond."""
    micros = lambda c: F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), "UTC"))
    return (micros(end) - micros(start)) / 1e6
