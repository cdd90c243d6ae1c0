from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larkspan.streaming import recipes

T0 = datetime(2026, 1, 1)


def test_transitions_previews_cooldowns_and_timers(spark, tmp_path):
    hours = lambda h: T0 + timedelta(hours=h)
    said = [
        [("a", 0, "enabled"), ("a", 1, "previewing"), ("a", 2, "preview_ready"), ("a", 3, "enabled"), ("b", 1, "previewing"), ("b", 2, "blocked"), ("b", 2.01, "enabled"), ("c", 1, "retired")],
        [("a", 4, "paused"), ("a", 40, "enabled"), ("b", 5, "previewing"), ("b", 6, "preview_ready"), ("b", 31, "enabled"), ("c", 9, "previewing"), ("c", 9.5, "enabled")],
        [("d", 90, "previewing")],
    ]
    for n, batch in enumerate(said):
        rows = spark.createDataFrame([(k, f"{n}{i:03d}", hours(h), t) for i, (k, h, t) in enumerate(batch)], "recipe string, place string, at timestamp, target string")
        rows.withColumn("at_ms", F.unix_millis("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    schema = "recipe string, place string, at timestamp, target string, at_ms long"
    spark.sql("SELECT 1").collect()
    out, place = str(tmp_path / "out"), str(tmp_path / "state")
    import shutil

    landing = tmp_path / "landing"
    landing.mkdir()
    with recipes.state_store(spark):
        for n in range(3):  # a run a file, over the same state
            for f in (tmp_path / f"in/{n}").glob("*.parquet"):
                shutil.copy(f, landing / f"{n}-{f.name}")
            stream = spark.readStream.schema(schema).parquet(str(landing)).select("recipe", "place", "at", "at_ms", "target")
            run = recipes.lifecycle(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
            run.awaitTermination()
    told = spark.read.schema(recipes.OUTPUT).parquet(out).collect()
    asked = {r["place"]: (r["status"], r["error"]) for r in told if r["kind"] == "request"}
    bad, need = "recipe_status_transition_invalid", "preview_required"
    assert [asked[p] for p in sorted(asked)] == [
        ("draft", need), ("previewing", None), ("preview_ready", None), ("enabled", None), ("previewing", None), ("blocked", None), ("blocked", need), ("retired", None),
        ("paused", None), ("enabled", None), ("previewing", None), ("preview_ready", None), ("preview_ready", need), ("retired", bad), ("retired", bad), ("previewing", None),
    ]
    cooled = {r["place"]: r["cooldown_until"] for r in told if r["cooldown_until"] is not None}
    assert set(cooled) == {"0005", "0006"} and cooled["0005"] - next(r["at_ms"] for r in told if r["place"] == "0005") == recipes.COOLDOWN_MS
    fired = {(r["recipe"], r["kind"]) for r in told if r["kind"] != "request"}
    assert {("a", "preview_expired"), ("b", "preview_expired"), ("b", "cooldown_over")} >= fired and ("b", "cooldown_over") in fired and ("a", "preview_expired") in fired
