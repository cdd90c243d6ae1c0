import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspan.functions import jobs, text
from larkspan.operators import candidates


def one(spark, f, *texts):
    frame = spark.createDataFrame([texts], ", ".join(f"t{i} string" for i in range(len(texts))))
    return frame.select(f(*[F.col(c) for c in frame.columns]).alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "wanted"), [("Junior / Mid", ["junior", "mid"]), ("5 years of experience", []), ("Senior Tech Lead", ["senior", "lead"]), ("Trưởng nhóm", ["lead"]), (None, [])])
def test_levels(spark, raw, wanted):
    assert one(spark, jobs.levels, raw) == wanted


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("30-50 triệu VND/tháng", ("30000000", "50000000", "VND", "month", [])),
        ("Up to 2,000 USD/month", (None, "2000", "USD", "month", [])),
        ("30 - 50 triệu/tháng", ("30000000", "50000000", None, "month", [])),
        ("$1000/month", (None, None, None, None, ["ambiguous_currency_symbol", "insufficient_salary_evidence"])),
        ("Thỏa thuận", (None, None, None, None, ["salary_not_numeric"])),
        ("5000 - 3000 USD/month", (None, None, None, None, ["salary_range_reversed"])),
        ("1.5 triệu VNĐ", ("1500000", "1500000", "VND", None, [])),
    ],
)
def test_salary(spark, raw, wanted):
    v = one(spark, jobs.salary, raw)
    plain = lambda d: None if d is None else format(d.normalize(), "f")
    assert (plain(v["minimum"]), plain(v["maximum"]), v["currency"], v["period"], v["warnings"]) == wanted


@pytest.mark.parametrize(
    ("token", "wanted"),
    [("1,234.5", "1234.5"), ("1.234,56", "1234.56"), ("1,234,567", "1234567"), ("1,23,456", None), ("1.500", "1500"), ("1.5", "1.5"), ("12", "12"), ("1,234.567", "1234567")],
)
def test_number(spark, token, wanted):
    assert one(spark, jobs.number, token) == (None if wanted is None else Decimal(wanted))


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("3+ years", (3, None, [])), ("1-3 năm kinh nghiệm", (1, 3, [])), ("Senior level", (None, None, ["experience_unit_missing"])), ("2 years", (2, None, ["experience_interpreted_as_minimum"])), ("up to 4 yrs", (None, 4, []))],
)
def test_experience(spark, raw, wanted):
    v = one(spark, jobs.experience, raw)
    assert (v["minimum"], v["maximum"], v["warnings"]) == wanted


def test_location(spark):
    assert tuple(one(spark, jobs.location, "Ho Chi Minh City, Vietnam (Hybrid)")) == ("Ho Chi Minh City", "Ho Chi Minh City", "hybrid", [])
    assert tuple(one(spark, jobs.location, "Hanoi / HCMC")) == (None, None, None, ["ambiguous_location"])
    assert tuple(one(spark, jobs.location, "Remote - Vietnam")) == (None, None, "remote", [])
    assert one(spark, jobs.location, None) is None


def test_skills_roles_and_names(spark):
    found = one(spark, jobs.skills, "Python Engineer", "Kafka is a plus; SQL\nDocker not required\nKafka daily\nGolang preferred")
    assert [tuple(s) for s in found] == [("apache-kafka", "required"), ("go", "optional"), ("python", "required"), ("sql", "required")]
    assert tuple(one(spark, jobs.role, "Backend Engineer", "some devops")) == ("backend", 0.9)
    assert tuple(one(spark, jobs.role, "Engineer", "backend and frontend")) == (None, None)
    assert one(spark, jobs.canonical_skill, " Amazon  Web Services ") == "aws" and one(spark, jobs.canonical_skill, "Big Data") == "big-data"
    assert one(spark, jobs.skill_category, "k8s") == "devops" and one(spark, jobs.skill_category, "Excel") == "other"


def test_documents(spark):
    base = "https://jobs.example.com/list"
    ld = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@type":"JobPosting","title":"A  B","hiringOrganization":{"name":"Co"},"url":"/j/1#x","identifier":{"value":"7"}}}]}</script><div class="job-card">no</div>'
    cards = '<article class="job-card" data-job-id="9"><h2><a href="/j/2">Dev</a></h2><p class="company-name">Acme</p><span class="job-location">Hanoi</span></article><article class="job-card"><h2>none</h2></article>'
    docs = [
        (1, ld, "text/html", base), (2, cards, "text/html; charset=utf-8", base), (3, '{"jobs":[{"title":"T","company":"C","url":"https://evil.test/1"},{"title":"T","company":"C","url":"/ok"}]}', "application/json", base),
        (4, "title,company,url\nX,Y,/z\n", "text/csv", base), (5, "title,company,url\nX,Y\n", "text/csv", base), (6, ld + "please solve the captcha", "text/html", base), (7, "{bad", "application/json", base),
    ]
    found = candidates.parse_documents(spark.createDataFrame(docs, "doc_id long, payload string, content_type string, base_url string")).orderBy("doc_id", "place").collect()
    assert [(r["doc_id"], r["method"], r["title"], r["company"], r["url"]) for r in found] == [
        (1, "structured_data", "A B", "Co", "https://jobs.example.com/j/1"), (2, "page_field", "Dev", "Acme", "https://jobs.example.com/j/2"),
        (3, "structured_json", "T", "C", "https://evil.test/1"), (3, "structured_json", "T", "C", "https://jobs.example.com/ok"), (4, "structured_csv", "X", "Y", "https://jobs.example.com/z"),
    ]
    assert [r["external_id"] for r in found[:2]] == ["7", "9"] and len(found[2]["external_id"]) == 64 and found[1]["location"] == "Hanoi"


def test_text_facts_read_every_line(spark, tmp_path):
    from larkspan.plans.queries import text_facts

    texts = ["About us\nWe are here\n3+ years", "About us\n2 years", "About us\n5000 - 3000 USD/month", "3+ years", "About us\nno figures", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'src' AS source").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(text):
        """For these texts: a number of years or a reversed range of pay, wherever it stands."""
        if text is None:
            return None, None
        n, years = [int(x) for x in re.findall(r"\d+", text)], "years" in text
        experience = ["experience_unit_missing"] if not years else [] if "+" in text else ["experience_interpreted_as_minimum"]
        salary = ["salary_not_numeric"] if not n else ["insufficient_salary_evidence"] if len(n) == 1 else ["salary_range_reversed"]
        return experience, salary

    found = {r["doc_id"]: (r["experience"], r["salary"]) for r in text_facts(spark, str(tmp_path)).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}


def test_names_and_places_of_fields_in_records(spark):
    def parsed(*records):
        docs = [(1, json.dumps({"jobs": list(records)}), "application/json", "https://jobs.example.com/list")]
        return candidates.parse_documents(spark.createDataFrame(docs, "doc_id long, payload string, content_type string, base_url string")).collect()

    plain = {"name": "T", "employer": "E", "absolute_url": "/a", "externalId": "x1", "location_name": "Hanoi", "seniority": "senior", "description_text": "d", "postedAt": "2024"}
    nested = {"title": "T", "hiringOrganization": {"name": "H"}, "link": "/b", "identifier": {"value": 7}, "jobLocation": [{"address": {"addressLocality": "Hue"}}]}
    both = {"title": "T", "company": "C", "hiringOrganization": {"name": "H"}, "jobUrl": "/c", "job_url": "/other", "id": None, "externalId": "no"}
    found = parsed(plain, nested, both, {"title": None, "name": "T", "company": "C", "url": "/d"})
    assert [(r["title"], r["company"], r["url"][-2:], r["location"], r["level"], r["description"], r["posted_at"]) for r in found] == [
        ("T", "E", "/a", "Hanoi", "senior", "d", "2024"), ("T", "H", "/b", "Hue", None, None, None), ("T", "C", "/c", None, None, None, None),
    ]
    assert [r["external_id"] for r in found[:2]] == ["x1", "7"] and len(found[2]["external_id"]) == 64


def test_contacts_are_redacted(spark):
    said = "Mail Ann.B@x-y.co or +84 90 123 45 67, (0)912.345.678, not 0123456789012 nor 12345"
    assert one(spark, text.redact_contacts, said) == "Mail [redacted-email] or [redacted-phone], ([redacted-phone], not 0123456789012 nor 12345"


def test_most_years(spark):
    said = {"5 years, then 12+ yrs and 99 years": Decimal("12.0"), "2,5 năm\n1 year": Decimal("2.5"), "none": None, "120 years": None, "3yearsold": None}
    assert {t: one(spark, jobs.most_years, t) for t in said} == said


def test_facts_look_at_a_text_a_bounded_number_of_times(spark):
    frame = spark.createDataFrame([("Java lead", "Python; kafka a plus\nno sql: not required; salary from 1,000 USD to 2 million per month")], "title string, body string")
    title, body = F.col("title"), F.col("body")
    plan = lambda c: frame.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    assert plan(jobs.skills(title, body)).count("split(") == 1
    for fact in (jobs.salary(body), jobs.experience(body)):
        assert plan(fact).count("regexp_extract_all(") == 1
    found = frame.select(jobs.skills(title, body).alias("s"), jobs.role(title, body)["role"].alias("r")).first()
    assert [tuple(x) for x in found["s"]] == [("apache-kafka", "optional"), ("java", "required"), ("python", "required")] and found["r"] is None
