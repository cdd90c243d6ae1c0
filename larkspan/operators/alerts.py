"""Alert candidates, idempotency keys and the delivery ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delivery_key(rule: Column, job: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("alert:v1"), rule.cast("string"), job.cast("string"), content), 256)


def claim_deliveries(candidates: DataFrame, ledger: DataFrame, key: str, now: Column, stale_minutes: int = 10, most: int = 3) -> DataFrame:
    """``candidates`` with the decision by their entry in the ledger (key, status, attempts, tried_at): skip what was
    sent, what is pending and young, and what was tried ``most`` times; claim the rest with one more attempt."""
    joined = candidates.join(ledger.select(key, "status", "attempts", "tried_at"), key, "left")
    young = (F.col("status") == "pending") & (F.col("tried_at") > now - F.make_dt_interval(mins=F.lit(stale_minutes)))
    decision = F.when(F.col("status") == "sent", "sent").when(young, "pending").when(F.col("attempts") >= most, "exhausted").otherwise("claim")
    return joined.withColumn("decision", decision).withColumn("attempt", F.when(F.col("decision") == "claim", F.coalesce("attempts", F.lit(0)) + 1)).drop("status", "attempts", "tried_at")


def message(parts: list[tuple[Column, int]], missing: str = "not stated", most: int = 2000) -> Column:
    """The parts, trimmed and cut, in lines; a missing one is named so."""
    lines = [F.substring(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(missing)), 1, n) for c, n in parts]
    return F.substring(F.concat_ws("\n", *lines), 1, most)
