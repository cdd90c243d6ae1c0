"""Buckets and slots of time, in UTC."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_start(ts: Column, unit: str) -> Column:
    """The day, the Monday of the week, or the first of the month."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unit: {unit}")
    return F.date_trunc(unit, ts).cast("date")


def in_window(ts: Column, first: date, last: date) -> Column:
    """From the first day at 0:00 to the last at 24:00, its end excluded; at most 366 days."""
    if not 0 <= (last - first).days <= 365:
        raise ValueError("a window has 1 to 366 days")
    return (ts >= F.lit(first).cast("timestamp")) & (ts < F.date_add(F.lit(last), 1).cast("timestamp"))


def interval_slot(ts: Column, minutes: int) -> Column:
    """The start of the fixed slot of so many minutes since the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / (60 * minutes)) * 60 * minutes)


def wall_slot(now: Column, minute_of_day: Column, zone: Column, weekday: Column | None = None) -> Column:
    """The latest time at or before ``now`` that a daily (or, with a weekday 0 = Monday, weekly) wall time came."""
    local = F.from_utc_timestamp(now, zone)
    day = F.date_trunc("day", local)
    if weekday is not None:
        day = F.date_add(day, -F.pmod(F.weekday(day) - weekday, F.lit(7))).cast("timestamp")
    step = 7 if weekday is not None else 1
    at = lambda back: F.to_utc_timestamp(F.date_add(day, -back).cast("timestamp") + F.make_dt_interval(mins=minute_of_day), zone)
    return F.when(at(0) <= now, at(0)).otherwise(at(step))


def iso_utc(text: Column) -> Column:
    """struct(at, warning) of an ISO time: only one with an offset or Z is a moment; else null, with a warning."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?")
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    at = F.when(shaped & has_offset, F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    warning = F.when(text.isNull() | at.isNotNull(), None).when(shaped & ~has_offset, "time_without_zone").otherwise("time_invalid")
    return F.struct(at.alias("at"), warning.alias("warning"))


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def within_budget(start: Column, now: Column, seconds: Column, deadline: Column) -> Column:
    """Whether ``now`` is before the deadline and the end of the budget, whichever comes first."""
    return now < F.least(deadline, start + F.make_dt_interval(secs=seconds))
