"""Health of sources from the counts of their runs."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The classes of error codes; all others are unexpected.
POLICY = ("invalid_url", "policy_blocked", "redirect_blocked", "source_config_mismatch")
TRANSIENT = ("dns_failure", "network_error", "network_timeout", "rate_limited", "server_error")
PLATFORM = ("persistence_failed", "run_not_found", "snapshot_not_found", "unexpected_error")
OPERATOR = ("cancelled", "operator_cancelled")


def baseline(runs: DataFrame, source: str, order: list[str], items: str, frame: int = 5) -> Column:
    """The median of the source's ``frame`` runs before, cut to a whole number; null without any."""
    window = Window.partitionBy(source).orderBy(*order).rowsBetween(-frame, -1)
    return F.floor(F.percentile(items, F.lit(0.5)).over(window)).cast("long")


def inventory_drops(runs: DataFrame, source: str, order: list[str], items: str, share: float = 0.5, least: int = 2) -> DataFrame:
    """``runs`` with baseline, earlier (runs in the frame) and dropped: fewer than ``share`` of a baseline that at
    least ``least`` runs made."""
    window = Window.partitionBy(source).orderBy(*order).rowsBetween(-5, -1)
    with_base = runs.withColumns({"baseline": baseline(runs, source, order, items), "earlier": F.count(items).over(window)})
    return with_base.withColumn("dropped", F.coalesce((F.col("earlier") >= least) & (F.col(items) < F.col("baseline") * share), F.lit(False)))


def failure_streaks(runs: DataFrame, source: str, order: list[str], failed: Column) -> DataFrame:
    """``runs`` with streak: how many runs up to this one failed in a row."""
    so_far = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(so_far)
    within = Window.partitionBy(source, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("_failed", failed.cast("int")).withColumn("_island", island).withColumn("streak", F.sum("_failed").over(within)).drop("_failed", "_island")


def status(streak: Column, quarantined: Column, unhealthy_at: int = 3) -> Column:
    """healthy, degraded, unhealthy or quarantined."""
    return F.when(quarantined, "quarantined").when(streak >= unhealthy_at, "unhealthy").when(streak > 0, "degraded").otherwise("healthy")


def finalized(error: Column, processed: Column, found: Column, covered: Column) -> tuple[Column, Column]:
    """(status, coverage) of a run: with an error it is partial if anything was processed and failed if not; only
    a run that succeeded, covered its listing and found something is complete."""
    status = F.when(~error, "succeeded").when(processed > 0, "partial").otherwise("failed")
    return status, F.when((status == "succeeded") & covered & (found > 0), "complete").otherwise("incomplete")


def error_class(code: Column) -> Column:
    return F.when(code.isin(*POLICY), "policy").when(code.isin(*TRANSIENT), "transient").when(code.isin(*PLATFORM), "platform").when(code.isin(*OPERATOR), "operator").when(code.isNotNull(), "other")


def health_machine(runs: DataFrame, source: str, order: str, items: str, code: str, frame: int = 5, least: int = 2, share: float = 0.5) -> DataFrame:
    """(source, order, status, reason, signal, failures, complete) after each run; ``code`` is null for a complete one.

    A complete run with fewer than ``share`` of the median of the last ``frame`` complete ones, if they are ``least``
    at least, is a drop: it counts as incomplete from then on, so that each run depends on those before. Success heals;
    policy errors quarantine; transient ones degrade, and are unhealthy at the third failure; platform errors are
    unhealthy; others degrade, and quarantine at the second failure; an operator's change nothing but the reason.
    Runs are sorted by source, and each task walks its rows once with one source's state in hand."""
    kinds = dict(runs.dtypes)
    names = [source, order, "status", "reason", "signal", "failures", "complete"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, status, failures, counts = None, "healthy", 0, []
        for batch in batches:
            out = []
            for s, at, n, said, kind in zip(batch[source], batch[order], batch[items], batch[code], batch["class"]):
                if s != current:
                    current, status, failures, counts = s, "healthy", 0, []
                base = int(median(counts)) if counts else 0
                reason = signal = said
                complete = kind is None
                if complete and len(counts) >= least and n < base * share:
                    status, failures, complete, reason, signal = "degraded", failures + 1, False, "inventory_drop_anomaly", "inventory_drop_anomaly"
                elif complete:
                    signal = None if status == "healthy" else "source_recovered"
                    status, failures, counts = "healthy", 0, [*counts, n][-frame:]
                elif kind != "operator":
                    failures += 1
                    late = {"policy": 1, "platform": 1, "transient": 3, "other": 2}[kind]
                    status = "degraded" if failures < late else "quarantined" if kind in ("policy", "other") else "unhealthy"
                out.append((s, at, status, reason, signal, failures, complete))
            yield pd.DataFrame(out, columns=names)

    dealt = runs.select(source, order, items, code, error_class(F.col(code)).alias("class")).repartition(F.col(source)).sortWithinPartitions(source, order)
    return dealt.mapInPandas(walk, f"{source} {kinds[source]}, {order} {kinds[order]}, status string, reason string, signal string, failures int, complete boolean")
