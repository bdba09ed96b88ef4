"""Numeric expressions: buckets, ages, intervals, percentiles, vectors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """1 + number of edges below the value (edges close to the right); 0 for NULL and negative values."""
    ladder = F.when(value.isNull() | (value < 0), 0)
    for i, edge in enumerate(edges, 1):
        ladder = ladder.when(value <= edge, i)
    return ladder.otherwise(len(edges) + 1)


def age_days(at: Column, now: datetime) -> Column:
    """Days from ``at`` to ``now``, at least 0; NULL stays NULL."""
    return F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now)) - F.unix_micros(at)) / 86_400_000_000.0)


# Hours to the next poll by the age in days below which they hold, for older ages, and where it is unknown.
POLL_LADDER, POLL_OLD, POLL_UNKNOWN = ((1, 1), (3, 3), (7, 6), (30, 12)), 24, 6


def poll_hours(age: Column) -> Column:
    """Hours to the next poll from the age in days of the newest item."""
    ladder = F.when(age.isNull(), POLL_UNKNOWN)
    for below, hours in POLL_LADDER:
        ladder = ladder.when(age < below, hours)
    return ladder.otherwise(POLL_OLD)


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """base * 2**(attempt - 1), at most ``cap``."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(60)) - 1))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable_vector(v: Column, dim: int) -> Column:
    """True for arrays of ``dim`` finite values that are not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0), F.lit(False))
