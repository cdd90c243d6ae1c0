"""Lists as readers ask for them: filters, fixed orders, pages with totals, lookups and projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.rows import all_of
from larkspan.operators.search import visible

#: The order of each list, a column with - from its end; nulls come last.
ORDERS = {
    "changes": ("-detected_at", "id"),
    "runs": ("-started_at", "id"),
    "sources": ("name", "id"),
    "rules": ("-created_at", "id"),
    "recipe_runs": ("-requested_at", "id"),
}


def equal_to(**wanted) -> Column:
    """The conjunction of the equalities that are asked for; None asks for nothing."""
    return all_of(*[None if value is None else F.col(name) == value for name, value in wanted.items()])


def has_level(levels: Column, level: str | None) -> Column:
    """Whether the array holds the level; a missing array holds none."""
    return F.lit(True) if level is None else F.coalesce(F.array_contains(levels, level), F.lit(False))


def with_accepted(rows: DataFrame, results: DataFrame, keys: list[str], versions: dict[str, object], name: Column) -> DataFrame:
    """Rows that any accepted result of the given versions, not the latest alone, has the named entry for."""
    fits = all_of(*[F.col(c) == v for c, v in versions.items()], name)
    return rows.join(results.where(fits).select(*keys).distinct(), keys, "left_semi")


def ordered(by: Iterable[str]) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in by]


def page_with_totals(rows: DataFrame, by: Iterable[str], number: int, size: int) -> DataFrame:
    """One page in a fixed order, each row with total_items and total_pages of the whole list; where the page has no rows,
    one row with these alone."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    totals = rows.agg(F.count(F.lit(1)).alias("total_items")).withColumn("total_pages", F.ceil(F.col("total_items") / size))
    shown = rows.orderBy(*ordered(by)).offset((number - 1) * size).limit(size)
    # one row on the left, a page on the right
    return totals.join(F.broadcast(shown), F.lit(True), "left").select(*rows.columns, "total_items", "total_pages")


def lookup(rows: DataFrame, key: str, value, owners: DataFrame, owner: str, approved: Column) -> DataFrame:
    """The row with the key, if its owner is visible."""
    return visible(rows.where(F.col(key) == value), owners, owner, approved)


def most_recent(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    if not 1 <= most <= 20:
        raise ValueError("from 1 to 20 rows")
    return rows.orderBy(F.col(at).desc(), F.col(key)).limit(most)


def summary(row: dict[str, Column], **nested: dict[str, Column]) -> list[Column]:
    """Flat columns, and a struct for each group of columns."""
    structs = [F.struct(*[c.alias(n) for n, c in fields.items()]).alias(name) for name, fields in nested.items()]
    return [*[c.alias(n) for n, c in row.items()], *structs]
