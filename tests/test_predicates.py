from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspan.functions import keys
from larkspan.operators import identity, predicates


def lit(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "wanted"),
    [("https://a.test/jobs/1", True), ("https://A.test/jobs", True), ("https://a.test/jobsite", False), ("http://a.test/jobs/1", False), ("https://u@a.test/jobs/1", False), ("https://a.test:8443/jobs/1", False), ("https://a.test/jobs/../x", False), ("https://a.test/jobs/%2e%2e/x", False), ("https://a.test/jobs#x", False), (None, False)],
)
def test_boundary(spark, url, wanted):
    assert lit(spark, predicates.within_boundary(F.lit(url).cast("string"), ["a.test"], ["/jobs/"])) is wanted


def test_disposition_and_retry(spark):
    d = lambda code, status=None, after=None: tuple(lit(spark, predicates.disposition(F.lit(code), F.lit(status).cast("int"), F.lit(after).cast("int"))))
    assert [d("http_error", 403), d("http_error", 402), d("http_error", 404), d("server_error", 403)] == [("access_denied", True, None), ("payment_required", True, None), ("layout_unavailable", True, None), ("source_unavailable", False, None)]
    assert [d("rate_limited", 429, n) for n in (9999, 5, -3, 0, None)] == [("rate_limited", False, n) for n in (3600, 5, 1, 60, 60)]
    assert {d(c) for c in ("invalid_url", "policy_blocked", "redirect_blocked", "too_many_redirects")} == {("route_policy_blocked", True, None)}
    assert {d(c) for c in ("dns_failure", "network_timeout", "tls_failure", "network_error", "server_error")} == {("source_unavailable", False, None)}
    assert {d(c) for c in ("response_too_large", "unexpected_content")} == {("layout_unavailable", True, None)}
    tried = {c: lit(spark, predicates.retryable(F.lit(c), F.lit(2))) for c in ("dns_failure", "network_error", "network_timeout", "server_error", "rate_limited", "tls_failure", "http_error")}
    assert [c for c, again in tried.items() if again] == ["dns_failure", "network_error", "network_timeout", "server_error"]
    assert not lit(spark, predicates.retryable(F.lit("server_error"), F.lit(3)))


def test_seniority_and_queue(spark):
    jobs = spark.createDataFrame([(1, " ", "Senior Dev"), (2, "junior", "Senior Dev"), (3, None, "Dev")], "id int, level_raw string, title string")
    assert [r["id"] for r in predicates.seniority(jobs, ["senior"]).collect()] == [1] and predicates.seniority(jobs, ["all"]).count() == 3
    queue = spark.createDataFrame([("s", datetime(2026, 1, 2), 1), ("s", None, 2), ("r", datetime(2026, 1, 1), 3), ("r", datetime(2026, 1, 1), 4)], "src string, at timestamp, id int")
    assert sorted(tuple(r) for r in predicates.oldest_due(queue, "src", "at", "id").collect()) == [("r", 3), ("s", 2)]


def test_resolve(spark):
    jobs = spark.createDataFrame([(1, 10, "e1", "u1"), (1, 11, "e2", "u2"), (1, 12, None, "u3")], "source_id int, job_id int, external_id string, canonical_url string")
    seen = spark.createDataFrame([(1, 1, "e1", "u1"), (2, 1, "e1", "u2"), (3, 1, "e9", "u1"), (4, 1, "e9", "u3"), (5, 1, None, "u1"), (6, 2, "e1", "u1"), (7, 1, "e2", "new")], "n int, source_id int, external_id string, canonical_url string")
    found = {r["n"]: (r["job_id"], r["error"]) for r in identity.resolve(seen, jobs, "n").collect()}
    assert found == {1: (10, None), 2: (None, "identity_conflict"), 3: (None, "identity_conflict"), 4: (12, None), 5: (10, None), 6: (None, None), 7: (11, None)}


def test_current_missing_and_detail(spark):
    rows = spark.createDataFrame([(1, "h1"), (2, "h2")], "id int, hash string")
    derived = spark.createDataFrame([(1, "h1", "v2"), (2, "old", "v2"), (2, "h2", "v1")], "id int, hash string, version string")
    assert [r["id"] for r in identity.current(derived, rows, ["id", "hash"], {"version": "v2"}).collect()] == [1]
    assert [r["id"] for r in identity.missing(rows, derived, ["id", "hash"], {"version": "v2"}).collect()] == [2]
    listing = spark.createDataFrame([("d", "e1", "u1", "short"), ("d", "e2", "u2", "short")], "doc string, ext string, url string, text string")
    detail = spark.createDataFrame([("d", 2, "e1", "zz", "by id"), ("d", 1, None, "u1", "by url")], "doc string, n int, ext string, url string, text string")
    assert sorted(tuple(r) for r in identity.detail_over_listing(listing, detail, "doc", "n", "ext", "url", ["text"]).collect()) == [("d", "e1", "u1", "by url"), ("d", "e2", "u2", "short")]


def test_keys(spark):
    assert lit(spark, keys.decimal_text(F.lit("50000000.0000").cast("decimal(19,4)"))) == "50000000" and lit(spark, keys.decimal_text(F.lit("1.5000").cast("decimal(19,4)"))) == "1.5"
    assert lit(spark, keys.recipe_code(F.lit("ab12cd34-ef"))) == "RCP-AB12CD34"
    assert lit(spark, keys.job_text(F.lit("a \n b"), F.lit(None).cast("string"))) == "Title: a b\nDescription: "
    assert lit(spark, keys.profile_text({"Skills": F.array(F.lit("b"), F.lit("a"), F.lit("b")), "Roles": F.array().cast("array<string>")})) == "Skills: a, b"
    assert lit(spark, keys.safe_filename(F.lit("/x/y\\cv.pdf"))) == "cv.pdf" and lit(spark, keys.safe_filename(F.lit("a/"))) == "document"
    assert lit(spark, keys.cost(F.lit(100), F.lit(None).cast("int"), F.lit(10), (0.1, 1.0, 2.0))) == 0.00012
