"""Evaluation of extraction, retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.sources.shared import stored


def extraction_scores(found: Column, wanted: Column) -> list[Column]:
    """Micro precision, recall and F1 over rows of two arrays, as aggregates."""
    hits, n_found, n_wanted = F.sum(F.size(F.array_intersect(found, wanted))), F.sum(F.size(found)), F.sum(F.size(wanted))
    share = lambda part, whole: F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
    return [
        F.round(share(hits, n_found), 6).alias("precision"),
        F.round(share(hits, n_wanted), 6).alias("recall"),
        F.round(share(2 * hits, n_found + n_wanted), 6).alias("f1"),
    ]


def retrieval_scores(ranked: DataFrame, query: str, position: str, relevant: str, k: int = 5, total: str | None = None) -> DataFrame:
    """One row: top-1, mean reciprocal rank and recall at k over ranked rows with a relevance flag.

    Where the ranking was cut, ``total`` names the number of all relevant rows of the query; else those ranked count."""
    each = ranked.groupBy(query).agg(
        F.min(F.when(F.col(relevant), F.col(position))).alias("first"),
        (F.max(total) if total else F.sum(F.when(F.col(relevant), 1).otherwise(0))).alias("n"),
        F.sum(F.when(F.col(relevant) & (F.col(position) <= k), 1).otherwise(0)).alias("within"),
    )
    return each.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")), 6).alias("top1"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("n") == 0, 0.0).otherwise(F.col("within") / F.col("n"))), 6).alias("recall"),
    )


def ndcg(scored: DataFrame, group: str, key: str, score: str, relevance: str, k: int = 5) -> DataFrame:
    """(group, ndcg): gain 2^relevance - 1, discount log2(rank + 1), ranks by score and then key."""
    gain = (F.pow(F.lit(2.0), F.col(relevance)) - 1) / F.log2(F.col("_r") + 1)

    def dcg(order: list[Column], name: str) -> DataFrame:
        ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
        return ranked.where(F.col("_r") <= k).groupBy(group).agg(F.sum(gain).alias(name))

    ideal = dcg([F.desc(relevance), F.col(key)], "ideal")
    return dcg([F.desc(score), F.col(key)], "got").join(ideal, group).select(group, F.round(F.when(F.col("ideal") > 0, F.col("got") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def ranked_values(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, below, times, n): each distinct value with the number of smaller ones and of its own, and of all.

    Values are counted, sorted by ranges, and numbered from the counts of the ranges before, so that a group of any
    size is never in one task or buffer."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("times"))
    ranges = stored(counted.repartitionByRange(F.col(group), F.col(value)).withColumn("part", F.spark_partition_id()), "ranked-ranges")
    sums = ranges.groupBy(group, "part").agg(F.sum("times").alias("size"))
    by_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col(group).alias("_group"), F.col("part").alias("_part"), before.alias("before"), F.sum("size").over(by_group).alias("n"))
    inside = Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranges.withColumn("inside", F.coalesce(F.sum("times").over(inside), F.lit(0))).join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")))
    return numbered.select(group, value, (F.col("before") + F.col("inside")).alias("below"), "times", "n")


def percentiles_by_rank(rows: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """(group, linear, nearest, floor, median, most) by a group of any size: the percentile interpolated between its
    neighbours, the one of the nearest rank, the one at the rank cut to a whole number, the median and the maximum."""
    ranked = ranked_values(rows, group, value)
    at = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("times")), F.col(value)))
    last = F.col("n") - 1
    found = ranked.groupBy(group, "n").agg(
        at(F.floor(last * share)).alias("low"), at(F.ceil(last * share)).alias("high"), at(F.ceil(F.col("n") * share) - 1).alias("nearest"),
        at(F.greatest(F.floor(F.col("n") * share) - 1, F.lit(0))).alias("floor"),
        at(F.floor(last / 2)).alias("half"), at(F.ceil(last / 2)).alias("other_half"), F.max(value).alias("most"),
    )
    between = last * share - F.floor(last * share)
    return found.select(group, (F.col("low") + (F.col("high") - F.col("low")) * between).alias("linear"), "nearest", "floor", ((F.col("half") + F.col("other_half")) / 2).alias("median"), "most")


def percentiles(rows: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """(group, linear, nearest, median) of every group, of any size, null for one without values: the percentile
    interpolated between its neighbours, the one of the nearest rank, and the median."""
    ranked = ranked_values(rows, group, value)
    at = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("times")), F.col(value)))
    last = F.col("n") - 1
    ends = {"low": F.floor(last * share), "high": F.ceil(last * share), "half": F.floor(last * 0.5), "other_half": F.ceil(last * 0.5), "nearest": F.ceil(F.col("n") * share) - 1}
    found = ranked.groupBy(F.col(group).alias("_group"), "n").agg(*[at(rank).alias(name) for name, rank in ends.items()])

    def between(low: str, high: str, share: float) -> Column:
        part = last * share - F.floor(last * share)
        return F.when(part == 0, F.col(low)).otherwise(F.col(low) + (F.col(high) - F.col(low)) * part).cast("double")

    told = found.select("_group", between("low", "high", share).alias("linear"), "nearest", between("half", "other_half", 0.5).alias("median"))
    groups = rows.select(group).distinct()
    return groups.join(told, groups[group].eqNullSafe(told["_group"]), "left").drop("_group")


def distinct_sorted(value: str) -> Column:
    return F.array_sort(F.collect_set(value))


def counts_of(rows: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """(column, n) for each kind, 0 for those that don't occur."""
    listed = rows.sparkSession.createDataFrame([(k,) for k in kinds], f"{column} string")
    return listed.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
