from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspan.operators import alerts, analytics, catalog, evaluate, health, limits, match, quality, rows, search


def rows_of(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_frequency_counts_against_the_cohort(spark):
    cohort = spark.createDataFrame([(i,) for i in range(4)], "job int")
    results = spark.createDataFrame([(0, ["sql", "sql", "python"]), (1, ["sql"]), (2, [])], "job int, skills array<string>")
    found = analytics.skill_frequency(analytics.cohort_skills(cohort, results, "job"))
    assert rows_of(found.select("skill", "jobs", "cohort", "analyzed", "share"), "skill") == [("python", 1, 4, 3, 0.25), ("sql", 2, 4, 3, 0.5)]


def test_trend_is_dense_over_buckets_with_members(spark):
    members = spark.createDataFrame([(datetime(2026, 1, 1), ["a"]), (datetime(2026, 1, 1), None), (datetime(2026, 1, 3), ["b", "a"])], "ts timestamp, skills array<string>")
    found = analytics.skill_trend(members, F.col("ts"), "day", 2)
    assert [tuple(r) for r in found.selectExpr("cast(bucket as string)", "skill", "jobs", "coverage", "share").orderBy("bucket", "skill").collect()] == [
        ("2026-01-01", "a", 1, 0.5, 0.5), ("2026-01-01", "b", 0, 0.5, 0.0), ("2026-01-03", "a", 1, 1.0, 1.0), ("2026-01-03", "b", 1, 1.0, 1.0)
    ]


def test_page_puts_nulls_last(spark):
    frame = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 5)], "id int, v int")
    assert [r["id"] for r in rows.page(frame, "v", "id", 1, 4).collect()] == [3, 1, 4, 2]
    assert [r["id"] for r in rows.page(frame, "v", "id", 2, 3, descending=False).collect()] == [2]
    with pytest.raises(ValueError):
        rows.page(frame, "v", "id", 0, 10)


def test_overlaps(spark):
    frame = spark.createDataFrame([(1, 10, 20), (2, 30, None), (3, None, None), (4, None, 5)], "id int, lo int, hi int")
    assert [r["id"] for r in frame.where(rows.overlaps(F.col("lo"), F.col("hi"), 15, 30)).orderBy("id").collect()] == [1, 2]


def test_outcomes(spark):
    t = lambda d: datetime(2026, 1, d)
    seen = [("k", 1, t(1), "a"), ("k", 2, t(2), "a"), ("k", 3, t(3), "b"), ("k", 4, t(3), "b"), ("k", 5, t(3), "c"), ("k", 6, t(2), "z"), ("k", 7, t(4), "b")]
    frame = spark.createDataFrame(seen, "key string, n int, at timestamp, content string")
    done = catalog.observation_outcomes(frame, ["key"], "at", ["n"], "content")
    assert [r["outcome"] for r in done.orderBy("n").collect()] == ["created", "unchanged", "updated", "replayed", "conflict", "stale", "unchanged"]


def test_change_log(spark):
    frame = spark.createDataFrame([("k", 1, "a", None), ("k", 2, "a", "x"), ("k", 3, "b", "x")], "key string, n int, title string, level string")
    log = catalog.change_log(frame, ["key"], ["n"], ["title", "level"])
    assert rows_of(log, "n", "field") == [("k", 2, "level", None, "x"), ("k", 3, "title", "a", "b")]


def test_lifecycle(spark):
    seen = spark.createDataFrame([("s", "j", 1), ("s", "j", 4), ("s", "x", 1), ("s", "x", 2), ("s", "x", 3), ("s", "x", 4)], "src string, job string, run int")
    runs = spark.createDataFrame([("s", r) for r in (1, 2, 3, 4)], "src string, run int")
    found = catalog.absence_lifecycle(seen, runs, "src", "run", "job").where("job = 'j'")
    assert [(r["run"], r["status"]) for r in found.orderBy("run").collect()] == [(1, "active"), (2, "missing"), (3, "removed"), (4, "active")]


def test_observed_and_insert_new(spark):
    jobs = spark.createDataFrame([(1, "u1", "e1"), (2, "u2", None), (3, "u3", "e3")], "id int, url string, ext string")
    seen = spark.createDataFrame([("u1", "zz"), ("nope", "e3"), (None, None)], "url string, ext string")
    assert rows_of(catalog.observed(jobs, seen, "id", [["url"], ["ext"]]), "id") == [(1,), (3,)]
    assert rows_of(rows.insert_new(jobs, spark.createDataFrame([(3,), (4,), (4,)], "id int"), ["id"]), "id") == [(4,)]


def test_health(spark):
    runs = spark.createDataFrame([("s", i, n) for i, n in enumerate((10, 12, 11, 4, 11))], "src string, run int, items long")
    found = health.inventory_drops(runs, "src", ["run"], "items").orderBy("run").collect()
    assert [(r["baseline"], r["dropped"]) for r in found] == [(None, False), (10, False), (11, False), (11, True), (10, False)]
    streaks = health.failure_streaks(runs, "src", ["run"], F.col("items") > 10).orderBy("run").collect()
    assert [r["streak"] for r in streaks] == [0, 1, 2, 0, 1]


def test_match_components(spark):
    skill = lambda p, j: spark.range(1).select(match.skill_component(p, j).alias("v")).first()["v"]
    mine = F.array(F.lit("a"), F.lit("b"))
    asked = F.array(F.struct(F.lit("a").alias("name"), F.lit("required").alias("requirement")), F.struct(F.lit("c").alias("name"), F.lit("optional").alias("requirement")))
    assert skill(mine, asked) == Decimal("0.7500")
    assert skill(mine, F.filter(asked, lambda x: F.lit(False))) == Decimal("0.0000")
    experience = lambda y, n: spark.range(1).select(match.experience_component(F.lit(y).cast("decimal(5,2)"), F.lit(n).cast("decimal(5,2)")).alias("v")).first()["v"]
    assert [experience(2, 3), experience(9, 3), experience(0, 0), experience(None, 3)] == [Decimal("0.6667"), 1, 1, None]
    score, coverage = match.overall({"skill": F.lit("0.5").cast("decimal(5,4)"), "role": F.lit(None).cast("decimal(5,4)")})
    assert tuple(spark.range(1).select(score, coverage).first()) == (Decimal("0.2000"), Decimal("0.4000"))
    score, coverage = match.overall({"skill": F.lit("0.5").cast("decimal(5,4)")}, {"skill": "0.70", "semantic": "0.30"})
    assert tuple(spark.range(1).select(score, coverage).first()) == (Decimal("0.3500"), Decimal("0.7000"))
    with pytest.raises(ValueError, match="add up"):
        match.overall({}, {"skill": "0.70"})


def test_claims(spark):
    now = datetime(2026, 1, 1, 12)
    ledger = [("a", "sent", 1, now), ("b", "pending", 1, datetime(2026, 1, 1, 11, 55)), ("c", "pending", 1, datetime(2026, 1, 1, 11)), ("d", "failed", 3, now)]
    frame = spark.createDataFrame(ledger, "key string, status string, attempts int, tried_at timestamp")
    wanted = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    done = alerts.claim_deliveries(wanted, frame, "key", F.lit(now).cast("timestamp"))
    assert rows_of(done, "key") == [("a", "sent", None), ("b", "pending", None), ("c", "claim", 2), ("d", "exhausted", None), ("e", "claim", 1)]


def test_message(spark):
    text = alerts.message([(F.lit(" Title "), 3), (F.lit(None).cast("string"), 20)])
    assert spark.range(1).select(text.alias("v")).first()["v"] == "Tit\nnot stated"


def test_nearest_has_ties_by_key(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 2.0])], "query_id int, query array<float>")
    found = search.nearest(vectors, queries, "id", "v", 2)
    assert rows_of(found, "query_id", "position") == [(8, 3, 1.0, 1), (8, 1, 0.0, 2), (9, 1, 1.0, 1), (9, 2, 1.0, 2)]


def test_ranking_scores(spark):
    judged = spark.createDataFrame([("q", 1, 0.9, 3), ("q", 2, 0.8, 0), ("q", 3, 0.7, 2)], "q string, id int, score double, rel int")
    assert evaluate.ndcg(judged, "q", "id", "score", "rel").first()["ndcg"] == round((7 + 3 / 2) / (7 + 3 / 1.584962500721156), 6)
    ranked = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("r", 1, True)], "q string, position int, relevant boolean")
    assert tuple(evaluate.retrieval_scores(ranked, "q", "position", "relevant").first()) == (2, 0.5, 0.75, 1.0)


def test_quality(spark):
    frame = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "id int, v int")
    checks = quality.report(quality.check_violations(frame, {"positive": F.col("v") > 0}), quality.duplicate_keys(frame, ["id"], "twice"), quality.orphans(frame, spark.createDataFrame([(1,)], "key int"), "id", "key", "lost"))
    assert rows_of(checks, "check") == [("lost", 1), ("positive", 1), ("twice", 1)]


def test_fixed_window(spark):
    events = spark.createDataFrame([("u", float(t), i) for i, t in enumerate((0, 10, 20, 59, 60, 61))] + [("w", 5.0, 9)], "user string, at double, id int")
    found = limits.fixed_window_limit(events, "user", "at", "id", 60, 2)
    assert rows_of(found, "user", "id") == [("u", 0, True, 0), ("u", 1, True, 0), ("u", 2, False, 40), ("u", 3, False, 1), ("u", 4, True, 0), ("u", 5, True, 0), ("w", 9, True, 0)]


def test_first_wins_is_not_transitive(spark):
    frame = spark.createDataFrame([("d", 1, "u1", "e1"), ("d", 2, "u1", "e2"), ("d", 3, "u2", "e2"), ("d", 4, "u3", "e1")], "doc string, n int, url string, ext string")
    assert [r["n"] for r in limits.first_wins(frame, "doc", "n", "url", "ext").orderBy("n").collect()] == [1, 3]
