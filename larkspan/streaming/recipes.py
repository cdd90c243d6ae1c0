"""The lifecycle of recipes over a stream of requests: transitions, previews that expire, cooldowns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Which status may follow which.
TRANSITIONS = {
    "draft": ("previewing", "retired"),
    "previewing": ("preview_ready", "blocked", "draft"),
    "preview_ready": ("enabled", "previewing", "retired"),
    "enabled": ("paused", "blocked", "previewing", "retired"),
    "paused": ("enabled", "previewing", "retired"),
    "blocked": ("previewing", "retired"),
    "retired": (),
}
PREVIEW_MS, COOLDOWN_MS = 24 * 3_600_000, 60_000
STATE = "status string, preview_until long, cooldown_until long"
OUTPUT = "recipe string, place string, at_ms long, kind string, status string, error string, cooldown_until long"


class RecipeLifecycle(StatefulProcessor):
    """A recipe's state is its status, until when its preview holds, and until when it cools down.

    A request for a status that can't follow is a row with recipe_status_transition_invalid, one to enable without a
    preview that holds is preview_required; neither changes the state. What blocks a recipe also cools it down. Timers in
    event time tell when a preview has expired and when a cooldown is over; the rules themselves go by the times of the
    requests, so that they don't depend on when a timer fires. A recipe's requests in one micro-batch are taken in
    their order; a trigger that limits the files of a batch bounds how many they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recipe", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, until, cooldown = self.state.get() if self.state.exists() else ("draft", None, None)
        requests = pd.concat(list(rows)).sort_values("place", kind="stable")
        out = []
        for place, ms, target in zip(requests["place"], requests["at_ms"], requests["target"]):
            error = None
            if target == "enabled" and status in ("preview_ready", "paused"):
                error = "preview_required" if status == "preview_ready" and (until is None or ms > until) else None
            elif target == "enabled" and status != "retired":
                error = "preview_required"
            elif target not in TRANSITIONS[status]:
                error = "recipe_status_transition_invalid"
            if error is None:
                status = target
                if target == "preview_ready":
                    until = int(ms) + PREVIEW_MS
                    self.handle.registerTimer(until)
                if target == "blocked":
                    cooldown = int(ms) + COOLDOWN_MS
                    self.handle.registerTimer(cooldown)
            out.append((key[0], place, int(ms), "request", status, error, cooldown if cooldown is not None and cooldown > ms else None))
        self.state.update((status, until, cooldown))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        status, until, cooldown = self.state.get() if self.state.exists() else ("draft", None, None)
        told = [k for k, due in (("preview_expired", until), ("cooldown_over", cooldown)) if due == at]
        yield _frame([(key[0], None, at, k, status, None, None) for k in told])
        self.state.update((status, None if until == at else until, None if cooldown == at else cooldown))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame(rows, columns=names, dtype=object).astype({"at_ms": "int64", "cooldown_until": "Int64"})


@contextmanager
def state_store(spark: SparkSession):
    """State with timers needs the store that keeps it on disk; the session's own setting comes back after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lifecycle(requests: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of OUTPUT from one of (recipe string, place string, at timestamp, at_ms long, target string).

    ``place`` orders a recipe's requests; ``at`` makes the watermark by which timers fire. Run it within
    :func:`state_store`."""
    keyed = requests.withWatermark("at", late).groupBy("recipe")
    return keyed.transformWithStateInPandas(RecipeLifecycle(), OUTPUT, "Append", "EventTime")
