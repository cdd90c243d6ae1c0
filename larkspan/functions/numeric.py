"""Rounded ratios, clamps, backoff and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded half even; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole, digits))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def backoff_seconds(attempt: Column, base: float, jitter: Column, share: float, retry_after: Column, most: float) -> Column:
    """base * 2^(attempt - 1), spread by jitter in [0, 1], at least what the server asked for, at most ``most``."""
    delay = F.lit(base) * F.pow(F.lit(2.0), attempt - 1) * (1 + (2 * jitter - 1) * share)
    return F.least(F.greatest(delay, F.coalesce(retry_after, F.lit(0.0))), F.lit(most))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def valid_vector(v: Column, dimension: int) -> Column:
    """Whether a vector has the right length and only finite numbers."""
    return (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def throughput(items: Column, milliseconds: Column) -> Column:
    """Items a second; null where no time went by."""
    return F.when(milliseconds > 0, items * 1000.0 / milliseconds)
