"""Fixed windows anchored at each key's first event, and first-wins deduplication by either of two keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_window_limit(events: DataFrame, key: str, seconds: str, order: str, window: int, limit: int) -> DataFrame:
    """(key, order, allowed, retry_after): a window starts with the first event after the one before has ended.

    Events are sorted by key and time, and each task walks its rows once with one counter in hand."""
    kinds = dict(events.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, n = None, 0.0, 0
        for batch in batches:
            out = []
            for k, at, o in zip(batch[key], batch[seconds], batch[order]):
                if k != current or at - start >= window:
                    current, start, n = k, at, 0
                allowed = n < limit
                n += allowed
                out.append((k, o, allowed, 0 if allowed else int(-(-(start + window - at) // 1))))
            yield pd.DataFrame(out, columns=[key, order, "allowed", "retry_after"])

    dealt = events.select(key, seconds, order).repartition(F.col(key)).sortWithinPartitions(key, seconds, order)
    return dealt.mapInPandas(walk, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, retry_after long")


def first_wins(rows: DataFrame, scope: str, order: str, a: str, b: str) -> DataFrame:
    """Rows of each scope, in order, whose ``a`` and ``b`` are both new among the rows kept before."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        seen_a, seen_b, kept = set(), set(), []
        group = group.sort_values(order, kind="stable")
        for i, (x, y) in enumerate(zip(group[a], group[b])):
            if x not in seen_a and y not in seen_b:
                kept.append(i)
                seen_a.add(x)
                seen_b.add(y)
        return group.iloc[kept]

    return rows.groupBy(scope).applyInPandas(keep, rows.schema)
