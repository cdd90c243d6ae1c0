"""Explainable scores of profiles against jobs, in decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weight of each component.
WEIGHTS = {"skill": "0.40", "semantic": "0.25", "experience": "0.15", "location": "0.10", "role": "0.10"}
#: The weight of a skill by how it is asked for.
REQUIREMENTS = {"required": 3, "preferred": 2, "optional": 1, "mentioned": 1}


def score4(value: Column) -> Column:
    """Rounded half up to 0.0001."""
    return F.round(value.cast("decimal(20,10)"), 4).cast("decimal(5,4)")


def skill_component(profile: Column, job: Column) -> Column:
    """The weighted share of a job's skills (struct name, requirement) that a profile has; null if the job wasn't
    analysed, 0 if it asks for none."""
    weigh = lambda s: F.coalesce(*[F.when(s["requirement"] == k, F.lit(w)) for k, w in REQUIREMENTS.items()], F.lit(1))
    total = F.aggregate(job, F.lit(0), lambda t, s: t + weigh(s))
    got = F.aggregate(F.filter(job, lambda s: F.array_contains(profile, s["name"])), F.lit(0), lambda t, s: t + weigh(s))
    return F.when(job.isNotNull(), score4(F.when(total == 0, F.lit(0)).otherwise(got.cast("decimal(10,0)") / total.cast("decimal(10,0)"))))


def experience_component(years: Column, least: Column) -> Column:
    """min(1, years / least); 1 where nothing is asked for; null if either is missing."""
    share = F.least(F.lit(1).cast("decimal(13,8)"), (years.cast("decimal(5,2)") / F.nullif(least.cast("decimal(5,2)"), F.lit(0))).cast("decimal(13,8)"))
    return F.when(years.isNotNull() & least.isNotNull(), score4(F.when(least == 0, F.lit(1)).otherwise(share)))


def overlap_component(mine: Column, theirs: Column) -> Column:
    """1 or 0, or null where either side says nothing."""
    said = (F.size(mine) > 0) & (F.size(theirs) > 0)
    return F.when(said, F.when(F.arrays_overlap(mine, theirs), F.lit(1)).otherwise(F.lit(0)).cast("decimal(5,4)"))


def overall(components: dict[str, Column], weights: dict[str, str] = WEIGHTS) -> tuple[Column, Column]:
    """(score, coverage): a missing component adds nothing to either. Weights are decimals as text, which add up to 1."""
    if sum(map(Decimal, weights.values())) != 1:
        raise ValueError("the weights don't add up to 1")
    weight = lambda k: F.lit(weights[k]).cast("decimal(3,2)")
    score = sum((F.coalesce(c, F.lit(0).cast("decimal(5,4)")) * weight(k) for k, c in components.items()), F.lit(0).cast("decimal(5,4)"))
    coverage = sum((F.when(c.isNotNull(), weight(k)).otherwise(F.lit(0).cast("decimal(3,2)")) for k, c in components.items()), F.lit(0).cast("decimal(3,2)"))
    return score4(score), score4(coverage)


def top_matches(scored: DataFrame, score: str, key: str, most: int = 100) -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(most)


def semantic_component(similarity: Column) -> Column:
    """A similarity in [0, 1] to four digits; null stays null, and so becomes what isn't a number in the range."""
    return F.when(similarity.between(0, 1) & ~F.isnan(similarity), score4(similarity))


def explanation(skill: Column, semantic: Column, experience: Column, location: Column, role: Column) -> Column:
    """Five tokens, one for each component."""
    said = lambda c, name, yes, no: F.when(c.isNull(), f"{name}_unavailable").when(c == 1, f"{name}_{yes}").otherwise(f"{name}_{no}")
    of_skill = F.when(skill.isNull(), "skill_unavailable").when(skill == 1, "skill_complete").when(skill > 0, "skill_partial").otherwise("skill_no_match")
    of_meaning = F.when(semantic.isNull(), "semantic_unavailable").otherwise("semantic_available")
    return F.array(of_skill, of_meaning, said(experience, "experience", "meets_minimum", "below_minimum"), said(location, "location", "match", "mismatch"), said(role, "role", "match", "mismatch"))


def generation_report(scored: DataFrame, stored: DataFrame, existing: DataFrame, key: str, available: Column) -> DataFrame:
    """One row: how many were considered, analysed or not, stored, and of those made now or there before."""
    considered = scored.agg(F.count(F.lit(1)).alias("considered"), F.count_if(available).alias("available"), F.count_if(~available).alias("unavailable"))
    before = existing.select(key).distinct().withColumn("_there", F.lit(True))
    kept = stored.join(before, key, "left").agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("_there").isNull()).alias("created"), F.count("_there").alias("reused"))
    # one row each
    return considered.crossJoin(kept)
