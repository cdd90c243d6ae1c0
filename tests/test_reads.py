import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from larkspan.functions import arrays, jobs, keys, numeric, text, time
from larkspan.operators import catalog, evaluate, health, identity, listing, match


def test_pages_have_totals_and_nulls_last(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 4)) for i in range(23)], "id long, price double")
    first = listing.page_with_totals(rows, ["-price", "id"], 1, 10).collect()
    assert [r["id"] for r in first][:5] == [3, 7, 11, 19, 2] and {(r["total_items"], r["total_pages"]) for r in first} == {(23, 3)}
    assert [r["price"] for r in listing.page_with_totals(rows, ["-price", "id"], 3, 10).collect()] == [None] * 3
    beyond = listing.page_with_totals(rows, ["id"], 9, 10).collect()
    assert [(r["id"], r["total_items"], r["total_pages"]) for r in beyond] == [(None, first[0]["total_items"], first[0]["total_pages"])]
    empty = listing.page_with_totals(rows.limit(0), ["id"], 1, 10).collect()
    assert [(r["id"], r["total_items"], r["total_pages"]) for r in empty] == [(None, 0, 0)]
    for number, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            listing.page_with_totals(rows, ["id"], number, size)
    with pytest.raises(ValueError):
        listing.most_recent(rows, "price", "id", 21)


def test_filters_lookups_and_semi_joins(spark):
    jobs = spark.createDataFrame([(1, "a", ["senior"], "x"), (2, "a", None, "x"), (3, "b", [], "y")], "id long, status string, levels array<string>, owner string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(jobs.where(listing.equal_to(status="a", owner=None))) == [1, 2] and ids(jobs.where(listing.has_level(F.col("levels"), "senior"))) == [1]
    assert ids(jobs.where(listing.has_level(F.col("levels"), None))) == [1, 2, 3]
    owners = spark.createDataFrame([("x", True), ("y", False)], "owner string, approved boolean")
    assert ids(listing.lookup(jobs, "id", 1, owners, "owner", F.col("approved"))) == [1] and ids(listing.lookup(jobs, "id", 3, owners, "owner", F.col("approved"))) == []
    results = spark.createDataFrame([(1, "v2", ["python"]), (2, "v1", ["python"]), (3, "v2", None)], "id long, version string, names array<string>")
    results = results.withColumn("skills", F.transform("names", lambda n: F.struct(n.alias("name"))))
    assert ids(listing.with_accepted(jobs, results, ["id"], {"version": "v2"}, arrays.has_named(F.col("skills"), F.lit("python")))) == [1]


def test_arrays(spark):
    rows = spark.createDataFrame([(["b", "a"],), (["a", "a"],), ([],), (["z"],)], "x array<string>")
    x = F.col("x")
    got = rows.select(arrays.within(x, ["a", "b"]), arrays.repeats(x), arrays.sorted_unique(x), arrays.in_order(x, ["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(True, False, ["a", "b"], ["a", "b"]), (True, True, ["a"], None), (True, False, [], []), (False, False, ["z"], None)]
    values = spark.createDataFrame([("{\"all\": null}", "long text")], "j string, d string").select(
        arrays.has_key(F.col("j"), "all"), arrays.has_key(F.col("j"), "x"), arrays.change_value("title", F.col("d")), F.length(arrays.change_value("description", F.col("d"))))
    assert tuple(values.first()) == (True, False, "long text", 64)


def test_keys_tell_null_from_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("a|", None), ("a", "|")], "x string, y string")
    assert len({r[0] for r in rows.select(keys.key_of(F.col("x"), F.col("y"))).collect()}) == 4
    made = rows.select(keys.external_or_url(F.col("y"), F.col("x"))).collect()
    assert made[1][0] == "" and len(made[0][0]) == 64


def test_percentiles_by_rank_against_sorted_lists(spark):
    pick = random.Random(2)
    values = {g: [pick.choice((pick.random() * 10, float(pick.randrange(4)))) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 20), ("d", 997))}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("c", None)]
    found = {r["g"]: r for r in evaluate.percentiles_by_rank(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v").collect()}
    for g, vs in values.items():
        s, n = sorted(vs), len(vs)
        at = 0.95 * (n - 1)
        linear = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))
        r = found[g]
        assert abs(r["linear"] - linear) < 1e-9 and r["nearest"] == s[math.ceil(0.95 * n) - 1] and r["floor"] == s[max(int(0.95 * n) - 1, 0)]
        assert abs(r["median"] - statistics.median(vs)) < 1e-9 and r["most"] == s[-1]


def test_outcomes_with_reactivation_and_older_hashes(spark):
    rows = [(1, 1, "h1", "old1", "d"), (2, 2, "h1", "old1", "d"), (3, 30, "h2", "old2", "d"), (4, 30, "h3", "h2", "d"), (5, 31, "h4", "h2", "d"), (6, 5, "h9", "", "d"), (7, 32, "h5", "h4", "e"), (8, 32, "h6", "", "e")]
    observed = spark.createDataFrame([(1, *r) for r in rows], "k long, n long, at long, hash string, v1 string, text string")
    done = catalog.observation_outcomes(observed, ["k"], "at", ["n"], "hash", lambda newest: F.when(F.col("at") - newest > 20, "missing"), ("v1", "text"))
    assert [r["outcome"] for r in done.orderBy("n").collect()] == ["created", "unchanged", "reactivated", "replayed", "unchanged", "stale", "updated", "conflict"]
    counters = catalog.run_counters(done, ["k"]).first()
    assert (counters["considered"], counters["items_new"], counters["items_reactivated"], counters["items_failed"]) == (8, 1, 1, 1)
    assert [tuple(r) for r in catalog.status_changes(done, ["k"], ["n"]).orderBy("n").collect()] == [(1, 1, "status", None, "active"), (1, 3, "status", "missing", "active")]


def test_health_machine(spark):
    codes = [None, None, None, "cancelled", "network_error", "network_error", "rate_limited", None, "odd", "odd", "invalid_url", "run_not_found", None]
    found = [10, 12, 3, 0, 0, 0, 0, 11, 0, 0, 0, 0, 9]
    rows = [("s", i, n, c) for i, (n, c) in enumerate(zip(found, codes))] + [("t", 0, 5, "odd")]
    out = health.health_machine(spark.createDataFrame(rows, "source string, run long, items long, code string"), "source", "run", "items", "code").orderBy("source", "run").collect()
    assert [r["status"] for r in out] == ["healthy", "healthy", "degraded", "degraded", "degraded", "unhealthy", "unhealthy", "healthy", "degraded", "quarantined", "quarantined", "unhealthy", "healthy", "degraded"]
    assert [r["failures"] for r in out] == [0, 0, 1, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1] and not out[2]["complete"] and out[2]["signal"] == "inventory_drop_anomaly"
    assert out[7]["signal"] == "source_recovered" and out[3]["reason"] == "cancelled"


def test_match_report_and_tokens(spark):
    scored = spark.createDataFrame([(1, 1.0, 0.5, None), (2, 0.0, None, 1.0), (3, None, 2.0, 0.4)], "id long, skill double, semantic double, other double")
    report = match.generation_report(scored, scored.where("id < 3"), scored.where("id = 2"), "id", F.col("skill").isNotNull()).first()
    assert tuple(report) == (3, 2, 1, 2, 1, 1)
    tokens = [r[0] for r in scored.orderBy("id").select(match.explanation(*map(F.col, ("skill", "semantic", "other", "other", "other")))).collect()]
    assert tokens[0] == ["skill_complete", "semantic_available", "experience_unavailable", "location_unavailable", "role_unavailable"]
    assert tokens[1][:3] == ["skill_no_match", "semantic_unavailable", "experience_meets_minimum"] and tokens[2][3] == "location_mismatch"
    assert [r[0] and float(r[0]) for r in scored.orderBy("id").select(match.semantic_component(F.col("semantic"))).collect()] == [0.5, None, None]


def test_identity_helpers(spark):
    results = spark.createDataFrame([("k", None, "accepted", 1), ("k", "m", "accepted", 2), ("k", None, "rejected", 3)], "key string, model string, validation_status string, id long")
    assert [r["id"] for r in identity.cached(results, {"key": F.lit("k"), "model": F.lit(None).cast("string")}).collect()] == [1]
    mentions = spark.createDataFrame([(1, "sql", "mentioned"), (1, "sql", "required"), (1, "go", "optional")], "job long, name string, requirement string")
    assert {(r["name"], r["requirement"]) for r in identity.strongest(mentions, ["job"], "name", "requirement", match.REQUIREMENTS).collect()} == {("sql", "required"), ("go", "optional")}
    versions = spark.createDataFrame([(1, 1, "text", False), (1, 2, None, True), (1, 3, None, False)], "k long, n long, body string, partial boolean")
    assert [r["body"] for r in identity.keep_description(versions, ["k"], ["n"], "body", F.col("partial")).orderBy("n").collect()] == ["text", "text", None]


def test_times_and_mentions(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.5+02:00",), ("2024-01-02 03:04",), ("2024-13-40T00:00:00Z",), (None,)], "t string")
    got = [(str(r[0]), r[1]) for r in rows.select(time.iso_utc(F.col("t"))["at"], time.iso_utc(F.col("t"))["warning"]).collect()]
    assert got[0] == ("2024-01-02 03:04:05", None) and got[1][0].startswith("2024-01-02 01:04:05.5") and [g[1] for g in got[2:]] == ["time_without_zone", "time_invalid", None]
    one = rows.limit(1).select(
        time.within_budget(*[F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2024-01-01 00:00:09")], F.lit(10), F.lit("2024-01-01 00:01:00").cast("timestamp")),
        text.clean_mentions(F.array(F.lit(" a  b "), F.lit(" "))), text.canonical_text(F.lit(" Ha \n NOI ")), numeric.throughput(F.lit(5), F.lit(0)))
    assert tuple(one.first()) == (True, ["a b"], "ha noi", None)


def test_classified_skills(spark):
    rows = spark.createDataFrame([([("K8s", "required"), ("kubernetes", "optional")],), ([("sql", "required"), ("SQL", "required")],), ([("basket weaving", "required")],)], "s array<struct<name:string,requirement:string>>")
    got = [(r[0], [tuple(x) for x in r[1]]) for r in rows.select(jobs.classified_skills(F.col("s"))["status"], jobs.classified_skills(F.col("s"))["skills"]).collect()]
    assert got[0] == ("accepted", [("kubernetes", "required", "devops", 1.0), ("kubernetes", "optional", "devops", 1.0)])
    assert got[1] == ("rejected", [("sql", "required", "database", 1.0)]) and got[2] == ("needs_review", [("basket-weaving", "required", "other", 0.5)])


def test_distinct_sorted(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    assert rows.agg(evaluate.distinct_sorted("x")).first()[0] == ["a", "b"]


def test_percentiles_of_every_group_without_a_buffer_of_its_values(spark):
    pick = random.Random(4)
    values = {g: [pick.choice((pick.random() * 10, float(pick.randrange(4)))) for _ in range(n)] for g, n in (("a", 1), (None, 2), ("c", 21), ("d", 997))}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("c", None), ("none", None)]
    made = evaluate.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v")
    # no aggregate gathers values: what grows with a group is shuffled by ranges
    assert not re.search("percentile|collect", made._jdf.queryExecution().optimizedPlan().toString())
    found = {r["g"]: r for r in made.collect()}
    assert found.keys() == {*values, "none"} and tuple(found["none"])[1:] == (None, None, None)
    for g, vs in values.items():
        s, n = sorted(vs), len(vs)
        at = 0.95 * (n - 1)
        linear = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))
        assert abs(found[g]["linear"] - linear) < 1e-9 and found[g]["nearest"] == s[math.ceil(0.95 * n) - 1] and abs(found[g]["median"] - statistics.median(vs)) < 1e-9
