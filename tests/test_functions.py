from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larkspan.functions import numeric, text, time


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "wanted"), [("  a  b \r\n\r\n c ", "a b\nc"), ("é", "é"), ("a​b", "ab"), (" \n ", None), (None, None)])
def test_normalize_text(spark, raw, wanted):
    frame = spark.createDataFrame([(raw,)], "t string")
    assert frame.select(text.normalize_text(F.col("t")).alias("v")).first()["v"] == wanted


def test_multiline_keeps_one_blank_line(spark):
    assert one(spark, text.normalize_multiline(F.lit("\n a \n\n\n\n b\n"))) == "a\n\nb"


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("HTTP://Jobs.Example.com/a?utm_source=x&b=1&ref=z#top", "https://jobs.example.com/a?b=1"),
        ("https://example.com", "https://example.com"),
        ("https://example.com/?ref=x", "https://example.com/"),
    ],
)
def test_canonical_url(spark, url, wanted):
    assert one(spark, text.canonical_url(F.lit(url))) == wanted


def test_html_to_text(spark):
    page = "<html><script>x()</script><h2>Role</h2><ul><li>one</li><li>two &amp; three</li></ul><p>end</p></html>"
    assert one(spark, text.html_to_text(F.lit(page))).replace("\n\n", "\n") == "### Role\n- one\n- two & three\nend"


def test_redact_and_title(spark):
    assert one(spark, text.redact_emails(F.lit("to a.b@mail.example.com now"))) == "to [email] now"
    assert one(spark, text.page_title(F.lit("<TITLE>\n A  b </TITLE>"))) == "A b"
    assert one(spark, text.page_title(F.lit("<p>no</p>"))) is None


def test_ratio_and_backoff(spark):
    assert one(spark, numeric.ratio(F.lit(1), F.lit(32))) == 0.0312
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numeric.backoff_seconds(F.lit(3), 2.0, F.lit(0.5), 0.25, F.lit(None).cast("double"), 60.0)) == 8.0
    assert one(spark, numeric.backoff_seconds(F.lit(9), 2.0, F.lit(1.0), 0.25, F.lit(30.0), 60.0)) == 60.0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert round(one(spark, numeric.cosine(a, b)), 6) == 0.707107
    assert one(spark, numeric.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, numeric.valid_vector(a, 2)) and not one(spark, numeric.valid_vector(a, 3))
    assert not one(spark, numeric.valid_vector(F.array(F.lit(float("nan")), F.lit(0.0)), 2))


def test_buckets_and_windows(spark):
    at = F.lit(datetime(2026, 8, 23, 23, 59)).cast("timestamp")
    assert [one(spark, time.bucket_start(at, u)) for u in ("day", "week", "month")] == [date(2026, 8, 23), date(2026, 8, 17), date(2026, 8, 1)]
    assert one(spark, time.in_window(at, date(2026, 8, 23), date(2026, 8, 23)))
    with pytest.raises(ValueError):
        time.in_window(at, date(2026, 1, 2), date(2026, 1, 1))
    with pytest.raises(ValueError):
        time.bucket_start(at, "year")


def test_wall_slot_over_a_dst_gap(spark):
    now = F.lit(datetime(2026, 3, 8, 12, 0)).cast("timestamp")
    slot = F.date_format(time.wall_slot(now, F.lit(150), F.lit("America/New_York")), "yyyy-MM-dd HH:mm")
    assert one(spark, slot) == "2026-03-08 07:30"
    monday = F.date_format(time.wall_slot(now, F.lit(60), F.lit("UTC"), F.lit(0)), "yyyy-MM-dd HH:mm")
    assert one(spark, monday) == "2026-03-02 01:00"
