import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspan.operators import ledger
from larkspan.sources.versioned import Conflict, VersionedTable

ROWS = "id long, kind string, value long"


def files(path):
    found = {}
    for top, _, names in os.walk(os.path.join(path, "data")):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(top, n), "rb") as f:
                    found[os.path.join(top, n)] = f.read()
    return found


def table(spark, path, rows=(), keys=("id",), buckets=4):
    frame = spark.createDataFrame(list(rows), ROWS)
    made = VersionedTable.create(spark, str(path), frame.schema, list(keys), buckets)
    if rows:
        made.append(frame)
    return made


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_versions_stay_readable_and_a_taken_version_is_a_conflict(spark, tmp_path):
    made = table(spark, tmp_path / "t", [(1, "a", 1)])
    assert made.version() == 1 and content(made, 0) == [] and content(made) == [(1, "a", 1)]
    made.append(spark.createDataFrame([(2, "b", 2)], ROWS))
    assert content(made, 1) == [(1, "a", 1)] and len(content(made)) == 2
    with pytest.raises(Conflict):
        made._write_version(made.state(2))
    with pytest.raises(Conflict):
        VersionedTable.create(spark, str(tmp_path / "t"), made.read().schema, ["id"])


def test_a_writer_that_loses_the_race_judges_again(spark, tmp_path):
    made = table(spark, tmp_path / "t")
    rows = spark.createDataFrame([(1, "mine", 1), (2, "mine", 1)], ROWS)
    bases = []

    def make(base):
        if not bases:  # another writer comes first
            made.append(spark.createDataFrame([(1, "other", 0)], ROWS))
        bases.append(base["version"])
        return ledger.absent(rows, made._rows(base), ["id"]), None

    assert made.change(make) == 2 and bases == [0, 1]
    assert content(made) == [(1, "other", 0), (2, "mine", 1)]
    live = {f"{made.path}/{f}" for fs in made.state()["folders"].values() for f in fs}
    assert {os.path.dirname(f) for f in files(tmp_path / "t")} == live  # the lost attempt is gone


def test_transactions_and_keys_bring_a_row_once(spark, tmp_path):
    made = table(spark, tmp_path / "t")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "n", 1), (None, "n", 0), (3, "c", 9)], ROWS)
    for _ in range(2):
        assert ledger.insert_missing(made, rows, ["id"], ["value"], transaction=("w", 0)) == 1
    assert ledger.insert_missing(made, rows, ["id"], ["value"], transaction=("other", 0)) == 2
    assert content(made) == [(1, "a", 1), (3, "c", 9), (None, "n", 0)]
    # a number below the newest one is done as well
    assert ledger.insert_missing(made, rows.withColumn("id", F.lit(9).cast("long")), ["id"], ["value"], transaction=("w", 0)) == 2


def test_accepted_rows_once_a_key_and_others_always(spark, tmp_path):
    made = table(spark, tmp_path / "t", keys=("kind",))
    ok = F.col("value") > 0
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 0), (4, "b", None)], ROWS)
    second = spark.createDataFrame([(5, "a", 1), (6, "a", 0), (7, "b", 1)], ROWS)
    for n, rows in enumerate((first, second)):
        ledger.insert_missing(made, rows, ["kind"], ["id"], ok, ("w", n))
    assert [r[0] for r in content(made)] == [1, 3, 4, 6, 7]
    found = {r["id"]: (r["winner"], r["cached"]) for r in ledger.winners(made, first.unionByName(second), ["kind"], "id", ok).collect()}
    assert found == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (1, True), 6: (6, False), 7: (7, False)}


def test_a_stopped_and_a_replayed_stream_leave_each_row_once(spark, tmp_path):
    landing = str(tmp_path / "in")
    rows = spark.createDataFrame([(i, "k", i % 3) for i in range(40)], ROWS)
    for part in (rows.where("id < 15"), rows.where("id BETWEEN 10 AND 30"), rows.where("id >= 25")):
        part.coalesce(1).write.mode("append").parquet(landing)
    made = table(spark, tmp_path / "t")

    def run(sink, place):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        query = source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / place)).trigger(availableNow=True).start()
        query.awaitTermination()

    write = ledger.exactly_once(made, "w", ["id"], ["id"])

    def stops(batch, number):
        write(batch, number)
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        run(stops, "state")
    assert 15 <= len(content(made)) < 40
    run(write, "state")
    assert [r[0] for r in content(made)] == sorted(range(40), key=str) and made.version() == 3
    run(ledger.exactly_once(made, "again", ["id"], ["id"]), "other-state")
    assert len(content(made)) == 40


def test_a_merge_rewrites_touched_buckets_alone(spark, tmp_path):
    made = table(spark, tmp_path / "t", [(i, "old", i) for i in range(60)], buckets=16)
    before, held = files(tmp_path / "t"), made.state()["folders"]
    changes = spark.createDataFrame([(7, "new", 1), (100, "new", 2)], ROWS)

    def upsert(rows, new):
        return ledger.absent(rows, new, ["id"]).unionByName(new)

    touched = made.touched(changes)
    ledger.merge(made, changes, upsert)
    after = files(tmp_path / "t")
    assert all(after[f] == b for f, b in before.items()) and 1 <= len(touched) <= 2
    now = made.state()["folders"]
    assert {b for b in held if now[b] != held[b]} <= set(map(str, touched))
    assert content(made) == sorted([(i, "old", i) for i in range(60) if i != 7] + [(7, "new", 1), (100, "new", 2)], key=str)
    assert ledger.merge(made, changes.limit(0), upsert) == 2 and made.version() == 2


def test_a_rewrite_by_a_predicate(spark, tmp_path):
    made = table(spark, tmp_path / "t", [(1, "active", 1), (2, "done", 2), (3, "active", None)], buckets=8)
    ledger.rewrite(made, (F.col("kind") == "active") & (F.col("value") > 0), {"kind": F.lit("stopped"), "value": F.col("value") + 10})
    assert content(made) == [(1, "stopped", 11), (2, "done", 2), (3, "active", None)]
    assert ledger.rewrite(made, F.col("kind") == "none", {"kind": F.lit("x")}) == 2


def test_run_requests_as_if_they_came_in_order(spark):
    runs = spark.createDataFrame([("s1", "k1", "h1", "running"), ("s2", "k2", "h2", "succeeded")], "source string, key string, request_hash string, status string")
    asked = [("s1", "k1", "h1"), ("s1", "k1", "h9"), ("s1", "k3", "h1"), ("s2", "k2", "h2"), ("s2", "k4", "h4"), ("s2", "k4", "h4"), ("s2", "k4", "h5"), ("s2", "k6", "h4"), ("s2", "k2", "h0"), ("s3", "k", None), ("s3", "k", None)]
    requests = spark.createDataFrame([(n, datetime(2026, 1, 1), *a) for n, a in enumerate(asked)], "n int, at timestamp, source string, key string, request_hash string")
    got = [(r["outcome"], r["run_key"]) for r in ledger.run_requests(requests, runs, ["at", "n"]).orderBy("n").collect()]
    assert got == [
        ("reused", "k1"), ("idempotency_conflict", None), ("source_run_active", None), ("reused", "k2"), ("created", "k4"), ("reused", "k4"),
        ("idempotency_conflict", None), ("source_run_active", None), ("idempotency_conflict", None), ("created", "k"), ("reused", "k"),
    ]
