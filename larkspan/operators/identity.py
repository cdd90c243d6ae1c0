"""Which canonical row an observation is, and which derived rows are current."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(observations: DataFrame, jobs: DataFrame, row: str, scope: str = "source_id", external: str = "external_id", url: str = "canonical_url", job: str = "job_id") -> DataFrame:
    """``observations`` with job_id and error: found by external id or by url, both within the scope.

    Two different hits conflict, and so does a hit by url whose job has another external id."""
    known = jobs.select(scope, F.col(job).alias("_by_id"), F.col(external).alias("_ext")).where("_ext IS NOT NULL")
    urls = jobs.select(scope, F.col(job).alias("_by_url"), F.col(url).alias("_url"), F.col(external).alias("_other"))
    a, b = observations.alias("a"), known.alias("b")
    found = a.join(b, (F.col(f"a.{scope}") == F.col(f"b.{scope}")) & (F.col(f"a.{external}") == F.col("_ext")), "left").select("a.*", "_by_id")
    a, b = found.alias("a"), urls.alias("b")
    found = a.join(b, (F.col(f"a.{scope}") == F.col(f"b.{scope}")) & (F.col(f"a.{url}") == F.col("_url")), "left").select("a.*", "_by_url", "_other")
    conflict = (F.col("_by_id") != F.col("_by_url")) | (F.col("_by_id").isNull() & F.col("_by_url").isNotNull() & (F.col("_other") != F.col(external)))
    clash = F.coalesce(conflict, F.lit(False))
    return found.withColumn("error", F.when(clash, "identity_conflict")).withColumn(job, F.when(~clash, F.coalesce("_by_id", "_by_url"))).drop("_by_id", "_by_url", "_other")


def current(derived: DataFrame, rows: DataFrame, keys: list[str], versions: dict[str, str]) -> DataFrame:
    """Derived rows whose key and content hash are those of a row now, and whose versions are the given ones."""
    fits = reduce(and_, [F.col(c) == v for c, v in versions.items()], F.lit(True))
    return derived.where(fits).join(rows.select(*keys).distinct(), keys, "left_semi")


def missing(rows: DataFrame, derived: DataFrame, keys: list[str], versions: dict[str, str]) -> DataFrame:
    """Rows without a current derived row."""
    fits = reduce(and_, [F.col(c) == v for c, v in versions.items()], F.lit(True))
    return rows.join(derived.where(fits).select(*keys).distinct(), keys, "left_anti")


def cached(results: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Accepted results under a key in which null equals null."""
    return results.where(reduce(and_, [F.col(c).eqNullSafe(v) for c, v in keys.items()], F.col("validation_status") == "accepted"))


def detail_over_listing(listing: DataFrame, detail: DataFrame, scope: str, order: str, external: str, url: str, fields: list[str]) -> DataFrame:
    """``listing`` with the detail's fields where one fits by id or url, the first by ``order``; its identity stays."""
    values = F.struct(F.col(order), *fields)
    by = lambda key, name: detail.where(F.col(key).isNotNull()).groupBy(scope, key).agg(F.min_by(values, order).alias(name))
    joined = listing.join(by(external, "_a"), [scope, external], "left").join(by(url, "_b"), [scope, url], "left")
    best = F.when(F.col("_a").isNull() | (F.col(f"_b.{order}") < F.col(f"_a.{order}")), F.col("_b")).otherwise(F.col("_a"))
    return joined.withColumn("_best", best).withColumns({f: F.coalesce(F.col(f"_best.{f}"), F.col(f)) for f in fields}).drop("_a", "_b", "_best").select(listing.columns)


def strongest(mentions: DataFrame, keys: list[str], name: str, requirement: str, weights: dict[str, int]) -> DataFrame:
    """Of each key's mentions of a name the one that asks most, the first of equals by requirement."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)]), F.col(requirement)), F.lit(0))
    return mentions.groupBy(*keys, name).agg(F.max_by(requirement, F.struct(weight, requirement)).alias(requirement))


def keep_description(versions: DataFrame, keys: list[str], order: list[str], column: str, partial: Column) -> DataFrame:
    """Where a partial document has no value, the last one before it stays."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return versions.withColumn(column, F.when(partial, F.last(column, ignorenulls=True).over(before)).otherwise(F.col(column)))
