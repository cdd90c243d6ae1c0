"""Ranked rows, pages and keys that other operators build on."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def page(rows: DataFrame, sort: str, key: str, number: int, size: int, descending: bool = True) -> DataFrame:
    """One page in the order of a column, nulls last, ties by key."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(order, F.col(key)).offset((number - 1) * size).limit(size)


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def overlaps(low: Column, high: Column, least: float | None, most: float | None) -> Column:
    """Whether an open range meets [least, most]; a missing end takes the other one, no ends meet nothing."""
    return all_of(None if least is None else F.coalesce(high, low) >= least, None if most is None else F.coalesce(low, high) <= most)


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``rows`` those whose key isn't there yet, one of each key."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
