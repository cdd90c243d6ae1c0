"""Checks and orders of arrays, and of arrays of named structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_named(items: Column, name: Column | str) -> Column:
    """Whether a struct of the array has the name."""
    return F.coalesce(F.exists(items, lambda s: s["name"] == name), F.lit(False))


def within(items: Column, allowed: list[str]) -> Column:
    """Whether every entry is allowed; the empty array is."""
    return F.size(F.array_except(items, F.array(*map(F.lit, allowed)))) == 0


def bounded(items: Column, least: int, most: int) -> Column:
    return F.size(items).between(least, most)


def has_key(record: Column, key: str) -> Column:
    """Whether a JSON object has the key, even with null."""
    return F.coalesce(F.array_contains(F.json_object_keys(record), key), F.lit(False))


def sorted_unique(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def in_order(items: Column, order: list[str]) -> Column:
    """The entries in a fixed order; null if one repeats or isn't in it."""
    known = F.array(*map(F.lit, order))
    fits = within(items, order) & ~repeats(items)
    return F.when(fits, F.filter(known, lambda x: F.array_contains(items, x)))


def repeats(items: Column) -> Column:
    """Whether an entry occurs twice."""
    return F.size(items) != F.size(F.array_distinct(items))


def change_value(field: str, value: Column) -> Column:
    """A value as a change row holds it: a description by its digest, all else as text."""
    return F.sha2(value, 256) if field == "description" else value.cast("string")


def safe_errors(errors: Column, most: int = 16, width: int = 120) -> Column:
    """The first errors, each cut."""
    return F.transform(F.slice(errors, 1, most), lambda e: F.substring(e, 1, width))
