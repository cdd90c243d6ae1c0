from datetime import datetime

from larkspan.operators import catalog, limits
from larkspan.streaming import state


def streamed(spark, frame, path, transform, name):
    for part in (frame.where("n <= 3"), frame.where("n BETWEEN 4 AND 5"), frame.where("n > 5")):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_stream_outcomes_equal_the_batch(spark, tmp_path):
    t = lambda d: datetime(2026, 1, d)
    rows = [("k", 1, t(1), "a"), ("k", 2, t(2), "a"), ("k", 3, t(3), "b"), ("k", 4, t(3), "c"), ("j", 5, t(3), "z"), ("k", 6, t(2), "z"), ("j", 7, t(4), "y")]
    frame = spark.createDataFrame(rows, "key string, n int, at timestamp, content string")
    batch = {tuple(r) for r in catalog.observation_outcomes(frame, ["key"], "at", ["n"], "content").select("key", "n", "outcome").collect()}
    assert streamed(spark, frame, tmp_path, lambda s: state.stream_outcomes(s, "key", "at", "n", "content"), "outcomes") == batch


def test_stream_limit_equals_the_batch(spark, tmp_path):
    frame = spark.createDataFrame([("u", float(t), i) for i, t in enumerate((0, 10, 20, 59, 60, 61, 125), 1)], "user string, at double, n int")
    batch = {(r["user"], r["n"], r["allowed"]) for r in limits.fixed_window_limit(frame, "user", "at", "n", 60, 2).collect()}
    assert streamed(spark, frame, tmp_path, lambda s: state.stream_fixed_window(s, "user", "at", "n", 60, 2), "limited") == batch
