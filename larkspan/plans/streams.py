"""Registered queries of streams with timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.plans.queries import query
from larkspan.sources.shared import shared_path
from larkspan.sources.tables import table
from larkspan.streaming import recipes

_TARGETS = {"click": "previewing", "view": "preview_ready", "purchase": "enabled", "error": "blocked", "signup": "paused"}
_CAN = " ".join(f"WHEN '{s}' THEN [{', '.join(repr(t) for t in to)}]" for s, to in recipes.TRANSITIONS.items() if to)


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in _TARGETS.items())} END AS target,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'draft' AS status, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS cooldown, CAST(NULL AS BIGINT) AS ms FROM e
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN bad IS NULL THEN target ELSE status END, bad, CASE WHEN bad IS NULL AND target = 'preview_ready' THEN ms + {recipes.PREVIEW_MS} ELSE until END,
    CASE WHEN bad IS NULL AND target = 'blocked' THEN ms + {recipes.COOLDOWN_MS} ELSE cooldown END, ms
  FROM (SELECT e.user_id, e.n, e.event_id, e.target, e.ms, s.status, s.until, s.cooldown,
      CASE WHEN e.target = 'enabled' AND s.status IN ('preview_ready', 'paused') THEN CASE WHEN s.status = 'preview_ready' AND e.ms > s.until THEN 'preview_required' END
        WHEN e.target = 'enabled' THEN 'preview_required' WHEN NOT list_contains(CASE s.status {_CAN} ELSE [] END, e.target) THEN 'recipe_status_transition_invalid' END AS bad
    FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
)
SELECT event_id, status, error, CASE WHEN cooldown > ms THEN cooldown END AS cooldown_until FROM s WHERE n > 0
""")
def recipe_lifecycle(spark, d):
    """Users as recipes, their events as requests for a status, as a stream with state and timers."""
    target = F.create_map(*[F.lit(x) for pair in _TARGETS.items() for x in pair])[F.col("event_type")]
    at = F.col("ts").cast("timestamp")
    place = F.concat_ws(":", F.lpad(F.unix_micros(at).cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    schema = table(spark, d, "events").schema
    # a pattern, as a table may be one file or a folder
    source = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")
    asked = source.select(F.col("user_id").cast("string").alias("recipe"), place.alias("place"), at.alias("at"), F.unix_millis(at).alias("at_ms"), target.alias("target"))
    out = shared_path(spark, "recipes")
    with recipes.state_store(spark):
        run = recipes.lifecycle(asked).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "recipes-state")).trigger(availableNow=True).start()
        run.awaitTermination()
    told = spark.read.schema(recipes.OUTPUT).parquet(out).where("kind = 'request'")
    return told.select(F.substring_index("place", ":", -1).cast("long").alias("event_id"), "status", "error", "cooldown_until")
