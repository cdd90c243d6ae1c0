from pyspark.sql import functions as F

from larkspan.operators import landing

GOOD = '{"jobs": [{"title": "T", "company": "C", "url": "/1"}, {"title": "T", "company": "C", "url": "/1"}, {"title": "U", "company": "C", "url": "/2"}]}'


def test_decoding_refuses_what_does_not_fit(spark):
    rows = [
        ("é".encode(), "text/html"), ("é".encode("latin-1"), "text/html"), ("é".encode("latin-1"), 'text/plain; Charset = "ISO-8859-1"'), (b"a\x00b", "application/json"), (b"x", "image/png"),
        (b"x", "text/plain; charset=nope"), (b"x", None), (None, "text/csv"), ("é".encode("utf-16"), "text/plain; charset=utf-16"), (b"\xff", "text/plain; charset=idna"),
    ]
    got = [tuple(r["d"]) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, payload binary, kind string").select("i", landing.decoded(F.col("payload"), F.col("kind")).alias("d")).orderBy("i").collect()]
    assert got == [
        ("é", None), (None, "invalid_text_encoding"), ("é", None), (None, "invalid_text_content"), (None, "unsupported_text_content"), (None, "unsupported_charset"), (None, "unsupported_text_content"),
        ("", None), ("é", None), (None, "invalid_text_encoding"),
    ]


def test_snapshots_add_up(spark, tmp_path):
    for name, payload in (("a.html", b"<p>fine"), ("b.html", b"\xff\xfe\xff"), ("c.html", b"x")):
        (tmp_path / name).write_bytes(payload)
    files = landing.files(spark, str(tmp_path), "*.html")
    urls = {"a.html": "https://a.example/x", "b.html": "https://a.example/y", "c.html": "https://u@a.example/z"}
    fetched = files.select("name", F.create_map(*[F.lit(x) for p in urls.items() for x in p])[F.col("name")].alias("url"), F.lit("text/html").alias("content_type"), "payload")
    accepted, quarantined = landing.snapshots(fetched, ["a.example"])
    assert [(r["name"], r["text"], r["parse_status"]) for r in accepted.collect()] == [("a.html", "<p>fine", "pending")]
    assert {r["name"]: r["error"] for r in quarantined.collect()} == {"b.html": "invalid_text_encoding", "c.html": "provenance_url_outside_policy"}


def test_imports_whole_or_not_at_all(spark):
    many = "title,company,url\n" + "".join(f"T,C,/{i}\n" for i in range(9))
    rows = [
        ("j.json", "application/json", GOOD.encode("utf-8-sig")), ("j.JSON", "text/json; x", GOOD.encode()), ("j.html", "application/json", GOOD.encode()), ("j.json", "application/json", b"<p>"),
        ("h.html", "text/html", b"<p>none</p>"), ("c.csv", "text/csv", many.encode()), ("c.csv", "text/csv", b"{}"), ("c.csv", "text/csv", b"title,company,url\nT,C,https://other.example/\n"),
        ("c.csv", "text/csv", f"title,company,url\n{'t' * 501},C,/1\n".encode()), ("c.csv", "text/csv", b"a\x00"), ("c.csv", "text/csv", b""), ("c.csv", "text/csv", b"x" * 5000), ("h.html", "text/html", b"<p>solve the captcha"),
        ("j.json", "application/json", b"{bad"), ("noext", "text/csv", b"title"), ("c.csv", "text/csv", None), ("h.html", "text/html", b"<p>" * 300), ("c.csv", "text/csv", b" \n "),
    ]
    documents = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, name string, content_type string, payload binary")
    found, report = landing.imported(documents, "a.example", "https://a.example/list", 5, 4000)
    assert [(r["doc_id"], r["title"], r["url"]) for r in found.orderBy("doc_id", "place").collect()] == [(i, t, f"https://a.example/{n}") for i in (0, 1) for n, t in ((1, "T"), (2, "U"))]
    wanted = [None, None, "type_unsupported", "type_unsupported", "no_jobs", "invalid", "type_unsupported", "route_blocked", "invalid", "invalid", "invalid", "too_large", "challenge_detected", "invalid", "type_unsupported", "invalid", "invalid", "invalid"]
    rows = report.orderBy("doc_id").collect()
    assert [r["error"] for r in rows] == [w and f"document_import_{w}" for w in wanted]
    assert [r["items"] for r in rows[:3]] == [2, 2, 0] and not any(r["coverage_complete"] for r in rows)


def test_backfill_writes_what_has_not_changed(spark):
    def embed(batches):
        for texts in batches:
            yield texts.map(lambda t: [1.0, float("nan")] if t == "bad" else [1.0] if t == "short" else [float(len(t)), 0.0])

    rows = spark.createDataFrame([(1, "h1", "one"), (2, "h2", "two"), (3, "h3", "bad"), (4, "h4", "short"), (5, "h5", "five")], "id int, hash string, text string")
    known = spark.createDataFrame([(1, "h1"), (2, "old")], "id int, hash string")
    now = rows.withColumn("hash", F.when(F.col("id") == 5, "h6").otherwise(F.col("hash")))
    vectors, report = landing.backfill(rows, known, ["id", "hash"], F.col("text"), embed, 2, now)
    assert [(r["id"], r["vector"]) for r in vectors.collect()] == [(2, [3.0, 0.0])]
    assert report.first().asDict() == {"selected": 4, "created": 1, "stale": 1, "invalid": 2, "hits": 1}
    few, report = landing.backfill(rows, known, ["id", "hash"], F.col("text"), embed, 2, most=1)
    assert [r["id"] for r in few.collect()] == [2] and report.first()["selected"] == 1
