"""Predicates over jobs, URLs, queues and fetch errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.jobs import levels
from larkspan.operators.health import TRANSIENT

#: Fetch errors that leave the route, and those of a source that can't be reached.
ROUTE = ("invalid_url", "policy_blocked", "redirect_blocked", "too_many_redirects")
UNAVAILABLE = ("dns_failure", "network_timeout", "tls_failure", "network_error", "server_error")


def seniority(rows: DataFrame, selected: list[str], level_raw: str = "level_raw", title: str = "title") -> DataFrame:
    """Rows whose levels (from level_raw, or from the title where that is blank) meet the selected ones. With
    ``all`` selected every row stays."""
    if "all" in selected:
        return rows
    said = F.coalesce(F.nullif(F.trim(F.col(level_raw)), F.lit("")), F.col(title))
    return rows.where(F.arrays_overlap(levels(said), F.array(*[F.lit(s) for s in selected])))


def within_boundary(url: Column, hosts: list[str], prefixes: list[str]) -> Column:
    """Whether a URL is https on an allowed host below an allowed path, without user, port, fragment, dot segments
    or encoded separators."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#@:]+)(?=[/?]|$)", 1))
    path = F.regexp_extract(url, r"^https://[^/?#]+([^?#]*)", 1)
    plain = ~path.rlike(r"(^|/)\.{1,2}(/|$)") & ~F.lower(path).rlike("%2e|%2f|%5c") & ~url.contains("#") & ~path.contains("\\")
    below = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        below = below | (path == p) | path.startswith(f"{p}/") | F.lit(p == "")
    return F.coalesce(host.isin(*hosts) & plain & below, F.lit(False))


def due(status: Column, source: Column, kind: Column, next_run: Column, cooldown: Column, now: Column) -> Column:
    """Whether a queue entry may be claimed: enabled, with a source, not manual, its time and cooldown passed."""
    return (status == "enabled") & source.isNotNull() & (kind != "manual") & (next_run <= now) & (cooldown.isNull() | (cooldown <= now))


def oldest_due(queue: DataFrame, scope: str, requested: str, key: str) -> DataFrame:
    """The one entry of each scope to claim: the oldest, nulls first. A single writer applies it."""
    first = F.min(F.struct(F.col(requested).isNotNull().alias("known"), F.col(requested), F.col(key)))
    return queue.groupBy(scope).agg(first.alias("first")).select(scope, F.col(f"first.{key}").alias(key))


def allows_trigger(quarantined: Column, trigger: Column) -> Column:
    """A quarantined source is run by hand or replayed only."""
    return ~quarantined | trigger.isin("manual", "replay")


def disposition(code: Column, status: Column, retry_after: Column, default: int = 60, most: int = 3600) -> Column:
    """struct(outcome, blocked, cooldown): what becomes of a source after a fetch error.

    Statuses count for http_error alone. A rate limit cools down for the seconds that were asked for, ``default`` where
    none were, between 1 and ``most``; a source that can't be reached is tried again; all else blocks it."""
    http = lambda *said: (code == "http_error") & status.isin(*said)
    outcome = (
        F.when(http(401, 403), "access_denied").when(http(402), "payment_required").when(code.isin(*ROUTE), "route_policy_blocked")
        .when(code == "rate_limited", "rate_limited").when(code.isin(*UNAVAILABLE), "source_unavailable").otherwise("layout_unavailable")
    )
    asked = F.when(retry_after > 0, retry_after).otherwise(F.when(retry_after < 0, F.lit(1)).otherwise(F.lit(default)))
    seconds = F.when(code == "rate_limited", F.least(asked, F.lit(most)))
    return F.struct(outcome.alias("outcome"), F.coalesce(~outcome.isin("rate_limited", "source_unavailable"), F.lit(True)).alias("blocked"), seconds.alias("cooldown"))


def retryable(code: Column, attempt: Column, most: int = 3) -> Column:
    """Transient errors are tried again, but for rate limits, up to ``most`` attempts."""
    return code.isin(*TRANSIENT) & (code != "rate_limited") & (attempt < most)


def expired(frame: DataFrame, expires: str, columns: list[str], now: Column) -> DataFrame:
    """``frame`` with the columns emptied where the row has expired."""
    return frame.withColumns({c: F.when(F.col(expires) > now, F.col(c)) for c in columns})
