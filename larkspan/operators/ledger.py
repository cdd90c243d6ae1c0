"""Writes that take effect once: keys that are in a table or in a batch already bring no second row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.sources.versioned import VersionedTable


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order, by a partial aggregate, so that a frequent key is no large group."""
    columns = rows.columns
    others = [c for c in columns if c not in order]
    first = rows.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order, *others)).alias("_row"))
    return first.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys ``known`` doesn't have; null keys are equal."""
    other = known.select(*[F.col(f"`{k}`").alias(f"_known{i}") for i, k in enumerate(keys)])
    same = [rows[f"`{k}`"].eqNullSafe(other[f"_known{i}"]) for i, k in enumerate(keys)]
    return rows.join(other, same, "left_anti")


def insert_missing(table: VersionedTable, rows: DataFrame, keys: list[str], order: list[str], unique: Column | None = None, transaction: tuple[str, int] | None = None) -> int:
    """Append the first row of each key that the table doesn't have, and return the version.

    Where ``unique`` is given, only its rows are unique by key, among its rows in the table; the others are all
    appended, each attempt of its own. ``keys`` must hold the table's own keys, as only the buckets of the new rows
    are looked at. A lost race for a version is judged again against the winner's rows."""
    once = F.coalesce(unique, F.lit(False)) if unique is not None else F.lit(True)

    def make(base: dict) -> tuple[DataFrame, None]:
        known = table._rows(base, table.touched(rows, base))
        fresh = absent(first_per_key(rows.where(once), keys, order), known.where(once), keys)
        return (fresh if unique is None else fresh.unionByName(rows.where(~once))), None

    return table.change(make, transaction)


def winners(table: VersionedTable, rows: DataFrame, keys: list[str], result: str, unique: Column | None = None, version: int | None = None) -> DataFrame:
    """``rows`` with the ``result`` column of the table's row of their key as winner, and whether that is another row
    than their own; rows that aren't unique by key are their own winner."""
    once = F.coalesce(unique, F.lit(False)) if unique is not None else F.lit(True)
    held = table.read(version).where(once).select(*[F.col(f"`{k}`").alias(f"_held{i}") for i, k in enumerate(keys)], F.col(f"`{result}`").alias("_held"))
    same = [rows[f"`{k}`"].eqNullSafe(held[f"_held{i}"]) for i, k in enumerate(keys)]
    found = rows.withColumn("_once", once).join(held, same, "left")
    winner = F.when(F.col("_once"), F.col("_held")).otherwise(F.col(f"`{result}`"))
    return found.withColumn("winner", winner).withColumn("cached", F.col("winner") != F.col(f"`{result}`")).select(*rows.columns, "winner", "cached")


def exactly_once(table: VersionedTable, writer: str, keys: list[str], order: list[str], unique: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: a batch number that the writer has committed is skipped, keys that the table
    has bring no row, so that neither a stream that is stopped and goes on nor one that is replayed from the start
    leaves a row twice."""

    def write(batch: DataFrame, number: int) -> None:
        insert_missing(table, batch, keys, order, unique, (writer, number))

    return write


def merge(table: VersionedTable, changes: DataFrame, update: Callable[[DataFrame, DataFrame], DataFrame], transaction: tuple[str, int] | None = None) -> int:
    """Rewrite the buckets that the changes' keys fall into, and no others: their folders stay as they are.

    ``update`` gives the new rows of these buckets from (their rows, changes): an upsert, a delete, or any rewrite
    that leaves rows of other keys as they are."""

    def make(base: dict) -> tuple[DataFrame, list[int]] | None:
        buckets = table.touched(changes, base)
        return (update(table._rows(base, buckets), changes), buckets) if buckets else None

    return table.change(make, transaction)


def rewrite(table: VersionedTable, touched: Column, values: dict[str, Column], transaction: tuple[str, int] | None = None) -> int:
    """Set columns of the rows that fit ``touched``; only buckets with such a row are rewritten."""

    def make(base: dict) -> tuple[DataFrame, list[int]] | None:
        buckets = table.touched(table._rows(base).where(touched), base)
        if not buckets:
            return None
        held = table._rows(base, buckets)
        fits = F.coalesce(touched, F.lit(False))
        return held.select(*[F.when(fits, values[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in held.columns]), buckets

    return table.change(make, transaction)


#: States in which a run counts as active.
ACTIVE = ("pending", "running")


def run_requests(requests: DataFrame, runs: DataFrame, order: list[str]) -> DataFrame:
    """``requests`` (source, key, request_hash and more) with outcome and run_key, as if they came in ``order``.

    A key that the source has had is reused, or an idempotency_conflict if its request was another; else an active
    run of the source, one of ``runs`` (source, key, request_hash, status) or one that an earlier request has made,
    refuses as source_run_active; else the request is created, as the source's one active run. Runs are unique by
    (source, key). The first request of a source comes from a partial aggregate."""
    had = runs.select("source", "key", F.col("request_hash").alias("_had_hash")).withColumn("_had", F.lit(True))
    busy = runs.where(F.col("status").isin(*ACTIVE)).select("source").distinct().withColumn("_busy", F.lit(True))
    known = requests.join(had, ["source", "key"], "left").join(busy, "source", "left")
    new = known.where("_had IS NULL AND _busy IS NULL").groupBy("source").agg(F.min(F.struct(*order, "key", "request_hash")).alias("_first"))
    judged = known.join(new, "source", "left")
    own = F.struct(*order, "key", "request_hash")
    again = lambda same: F.when(same, "reused").otherwise("idempotency_conflict")
    return judged.withColumn(
        "outcome",
        F.when(F.col("_had"), again(F.col("request_hash").eqNullSafe(F.col("_had_hash"))))
        .when(F.col("_busy"), "source_run_active")
        .when(own == F.col("_first"), "created")
        .when(F.col("key") == F.col("_first.key"), again(F.col("request_hash").eqNullSafe(F.col("_first.request_hash"))))
        .otherwise("source_run_active"),
    ).select(*requests.columns, "outcome", F.when(F.col("outcome").isin("created", "reused"), F.col("key")).alias("run_key"))
