"""Data-quality checks as counts of violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): a check passes on null, as in SQL. All in one pass."""
    counts = [F.count_if(~c).alias(name) for name, c in checks.items()]
    one = rows.agg(*counts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])))


def duplicate_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def orphans(rows: DataFrame, parents: DataFrame, foreign: str, key: str, name: str) -> DataFrame:
    lost = rows.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
