"""Per-key state over streams: outcomes of observations, and fixed-window limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_outcomes(observations: DataFrame, key: str, seen_at: str, order: str, content: str) -> DataFrame:
    """A stream of (key, order, outcome), as larkspan.operators.catalog.observation_outcomes gives them for a batch.

    A key's state is the newest time and the content then applied; within a micro-batch a key's rows are taken in
    their order. Late rows are stale by the state, so that no watermark is needed."""
    kinds = dict(observations.dtypes)

    def outcome(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, applied = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        said = []
        for at, what in zip(rows[seen_at].astype("int64"), rows[content]):
            if newest is None:
                said.append("created")
            elif at < newest:
                said.append("stale")
                continue
            elif at == newest:
                said.append("replayed" if what == applied else "conflict")
                continue
            else:
                said.append("unchanged" if what == applied else "updated")
            newest, applied = int(at), what
        state.update((newest, applied))
        yield pd.DataFrame({key: rows[key], order: rows[order], "outcome": said})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, outcome string"
    return observations.groupBy(key).applyInPandasWithState(outcome, schema, "newest long, applied string", "append", GroupStateTimeout.NoTimeout)


def stream_fixed_window(events: DataFrame, key: str, seconds: str, order: str, window: int, limit: int) -> DataFrame:
    """A stream of (key, order, allowed): the batch operator fixed_window_limit with its counter as state."""
    kinds = dict(events.dtypes)

    def check(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values([seconds, order], kind="stable")
        allowed = []
        for at in rows[seconds]:
            if start is None or at - start >= window:
                start, n = float(at), 0
            allowed.append(n < limit)
            n += allowed[-1]
        state.update((start, n))
        yield pd.DataFrame({key: rows[key], order: rows[order], "allowed": allowed})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean"
    return events.groupBy(key).applyInPandasWithState(check, schema, "start double, n int", "append", GroupStateTimeout.NoTimeout)
