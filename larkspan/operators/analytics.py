"""Skill frequency and trend over a cohort, with denominators and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.numeric import ratio
from larkspan.functions.time import bucket_start


def cohort_skills(cohort: DataFrame, results: DataFrame, key: str, skills: str = "skills") -> DataFrame:
    """Each member of the cohort with its distinct skills: null is not analysed, an empty list is analysed."""
    return cohort.join(results.select(key, F.array_distinct(skills).alias("skills")), key, "left")


def skill_frequency(members: DataFrame) -> DataFrame:
    """(skill, jobs, cohort, analyzed, share): share of the whole cohort, analysed or not."""
    size = members.agg(F.count(F.lit(1)).alias("cohort"), F.count("skills").alias("analyzed"))
    counts = members.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("jobs"))
    # one row
    return counts.crossJoin(F.broadcast(size)).withColumn("share", ratio(F.col("jobs"), F.col("cohort")))


def skill_trend(members: DataFrame, ts: Column, unit: str, top: int) -> DataFrame:
    """(bucket, skill, jobs, cohort, analyzed, coverage, share) for the skills most frequent in all; every bucket
    that has members is dense over them."""
    dated = members.withColumn("bucket", bucket_start(ts, unit))
    sizes = dated.groupBy("bucket").agg(F.count(F.lit(1)).alias("cohort"), F.count("skills").alias("analyzed"))
    each = dated.select("bucket", F.explode("skills").alias("skill")).groupBy("bucket", "skill").agg(F.count(F.lit(1)).alias("jobs"))
    leading = each.groupBy("skill").agg(F.sum("jobs").alias("n")).orderBy(F.desc("n"), "skill").limit(top).select("skill")
    # ``top`` rows
    return (
        sizes.crossJoin(F.broadcast(leading)).join(each, ["bucket", "skill"], "left")
        .withColumn("jobs", F.coalesce("jobs", F.lit(0)))
        .withColumn("coverage", ratio(F.col("analyzed"), F.col("cohort")))
        .withColumn("share", ratio(F.col("jobs"), F.col("cohort")))
    )


def with_totals(cohort: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each member of the cohort with the number and the sum of its rows; those without stay, with 0."""
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return cohort.join(sums, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0.0))})
