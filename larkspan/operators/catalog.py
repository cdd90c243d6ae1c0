"""Canonical rows from observations: outcomes, change log, and the lifecycle of what is no longer seen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """sha256 of the columns' compact JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def observation_outcomes(observations: DataFrame, keys: list[str], seen_at: str, order: list[str], content: str, absent: Callable[[Column], Column] | None = None, legacy: tuple[str, str] | None = None) -> DataFrame:
    """Each observation, in the order of arrival, with its outcome.

    created: the first of its key. stale: older than the newest so far. replayed or conflict: as new as the newest,
    with the same or another content. Newer ones are reactivated if the row was absent before, by ``absent`` of the
    newest time so far, which gives the status that it had, null for active; old_status keeps it. Else they are
    unchanged or updated, against the content last applied. ``legacy`` names a hash of an
    older version and the description: where the first is what was applied and the second hasn't changed, the content
    counts as the same."""
    arrival = Window.partitionBy(*keys).orderBy(*order)
    before = arrival.rowsBetween(Window.unboundedPreceding, -1)
    numbered = observations.withColumn("_n", F.row_number().over(arrival))
    # of equally new ones the first to arrive is the one that was applied
    last = lambda c: F.max_by(c, F.struct(F.col(seen_at), -F.col("_n"))).over(before)
    known = numbered.withColumns({"_newest": F.max(seen_at).over(before), "_content": last(content)} | ({"_text": last(legacy[1])} if legacy else {}))
    same, replay = F.col(content) == F.col("_content"), F.col(content) == F.col("_content")
    if legacy:
        replay = replay | (F.col(legacy[0]) == F.col("_content"))
        same = same | ((F.col(legacy[0]) == F.col("_content")) & F.col(legacy[1]).eqNullSafe(F.col("_text")))
    away = absent(F.col("_newest")) if absent else F.lit(None).cast("string")
    gone = away.isNotNull()
    told = known.withColumn(
        "outcome",
        F.when(F.col("_newest").isNull(), "created")
        .when(F.col(seen_at) < F.col("_newest"), "stale")
        .when(F.col(seen_at) == F.col("_newest"), F.when(replay, "replayed").otherwise("conflict"))
        .when(gone, "reactivated")
        .when(same, "unchanged")
        .otherwise("updated"),
    )
    return told.withColumn("old_status", F.when(F.col("outcome") == "reactivated", away)).drop("_newest", "_content", "_n", "_text")


#: The outcomes that a run counts, by counter.
COUNTERS = {"items_new": "created", "items_updated": "updated", "items_reactivated": "reactivated", "items_unchanged": "unchanged", "items_stale": "stale", "items_replayed": "replayed", "items_failed": "conflict"}


def run_counters(outcomes: DataFrame, run: list[str]) -> DataFrame:
    """(run, a counter for each outcome, considered)."""
    counts = [F.count_if(F.col("outcome") == outcome).alias(name) for name, outcome in COUNTERS.items()]
    return outcomes.groupBy(*run).agg(F.count(F.lit(1)).alias("considered"), *counts)


def status_changes(outcomes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, field, old_value, new_value): a change of status for what was created or came back, with the status
    that it had."""
    rows = outcomes.where(F.col("outcome").isin("created", "reactivated"))
    return rows.select(*keys, *order, F.lit("status").alias("field"), F.col("old_status").alias("old_value"), F.lit("active").alias("new_value"))


def sightings(observations: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, first_seen, last_seen, n)."""
    return observations.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def change_log(versions: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """(keys, order, field, old_value, new_value) of each field that differs from the version before."""
    window = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(window) == 1
    entries = [F.struct(F.lit(f).alias("field"), F.lag(f).over(window).cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields]
    logged = versions.select(*keys, *order, first.alias("_first"), F.array(*entries).alias("_all")).where("NOT _first")
    return logged.select(*keys, *order, F.inline(F.filter("_all", lambda e: ~e["old_value"].eqNullSafe(e["new_value"]))))


def absence_lifecycle(seen: DataFrame, runs: DataFrame, scope: str, run: str, key: str) -> DataFrame:
    """(scope, key, run, status, missed) for each complete run from a key's first sighting on.

    Seen is active; one miss is missing, two in a row are removed; a later sighting starts anew. ``runs`` has the
    complete runs (scope, run) alone."""
    numbered = runs.select(scope, run).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(run)))
    sightings = seen.select(scope, key, run).distinct().join(numbered, [scope, run])
    first = sightings.groupBy(scope, key).agg(F.min("_n").alias("_first"))
    grid = first.join(numbered, scope).where("_n >= _first").join(sightings.select(scope, key, "_n", F.lit(1).alias("_seen")), [scope, key, "_n"], "left")
    order = Window.partitionBy(scope, key).orderBy("_n")
    island = F.sum(F.coalesce("_seen", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    missed = F.row_number().over(Window.partitionBy(scope, key, "_island").orderBy("_n")) - 1
    return grid.withColumn("_island", island).withColumn("missed", missed).select(
        scope, key, run, F.when(F.col("missed") == 0, "active").when(F.col("missed") == 1, "missing").otherwise("removed").alias("status"), "missed"
    )


def observed(jobs: DataFrame, observations: DataFrame, job_id: str, either: list[list[str]]) -> DataFrame:
    """Distinct ids of jobs that an observation fits by one of several sets of columns: one equi join for each."""
    found = [jobs.join(observations.select(*keys).distinct(), keys, "left_semi").select(job_id) for keys in either]
    return reduce(DataFrame.unionByName, found).distinct()


def purge_counts(parents: DataFrame, children: list[tuple[str, DataFrame, str]], key: str) -> DataFrame:
    """(table, rows) that would go with the parents: the parents' own and, level by level, their children.

    ``children`` has (name, table, its foreign key to the level before)."""
    level, out = parents, [parents.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("parent").alias("table"), "rows")]
    for name, table, foreign in children:
        level = table.join(level.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")
        out.append(level.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
        key = table.columns[0]
    return reduce(DataFrame.unionByName, out)
