import hashlib
import re

from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.operators import candidates, nodes
from larkspan.plans import pages as plans

BASE = "https://jobs.example.com/list"
DOCS = "doc_id long, payload string, content_type string, base_url string"
CARDS = """<body><article class="job-card" data-job-id="one"><a class="job-link" href="/jobs/one"><h2>Intern <b>Backend</b> Engineer</h2></a>
<p class="company">Example Labs</p><p class="location">Hanoi</p></article>
<div itemtype="https://schema.org/JobPosting"><h3 class="x">Second</h3><p class="EMPLOYER">Two</p><a href="//other.example.org/2#part">go</a><span class="seniority">senior</span></div>
<div class="card job"><h2>no company</h2><a href="/3">x</a></div>
<div class="job card"><h2>bad address</h2><p class="company">C</p><a href="https://jobs.example.com:99999/3">x</a></div></body>"""
ROWS = """<section class="result-row wide"><a class="detail-link" href="/jobs/a"><h2 class="position-name">A</h2></a><p class="org-name">One</p></section>
<section class="result-row"><a class="detail-link" href="/jobs/b"><h2 class="position-name">B</h2></a><p class="org-name">Two</p></section>"""
MAPPING = {
    "card": {"tag": "section", "class_tokens": ["result-row"]}, "title": {"class_tokens": ["position-name"]}, "company": {"class_tokens": ["org-name"]},
    "job_url": {"tag": "a", "class_tokens": ["detail-link"]}, "control": {"class_tokens": ["more"]},
}


def parsed(spark, docs, mapping=None):
    return candidates.parse_all(spark.createDataFrame(docs, DOCS), mapping).orderBy("doc_id", "place").collect()


def test_nodes_have_intervals_and_lenient_ends(spark):
    page = "<div id=A class='X y x'>one<p>two<br>three<b>four</p>five</div></span><ul><li>six<li>seven</ul>"
    found = nodes.page_nodes(spark.createDataFrame([(1, page), (2, None), (3, "no tags")], "doc_id long, html string")).orderBy("node").collect()
    assert [(r["node"], r["parent"], r["last"], r["depth"], r["tag"]) for r in found] == [
        (0, None, 3, 0, "div"), (1, 0, 3, 1, "p"), (2, 1, 2, 2, "br"), (3, 1, 3, 2, "b"), (4, None, 6, 0, "ul"), (5, 4, 6, 1, "li"), (6, 5, 6, 2, "li"),
    ]
    assert found[0]["classes"] == ["x", "y"] and found[0]["attrs"] == {"id": "A", "class": "X y x"} and found[0]["parts"] == ["one", "five"]


def test_bounds_of_nodes_and_depth(spark):
    pages = [(1, "<p>" * 256), (2, "<p>" * 257), (3, "<br>" * 50_000), (4, "<br>" * 50_001), (5, "<p>fine</p>")]
    found = nodes.page_nodes(spark.createDataFrame(pages, "doc_id long, html string")).groupBy("doc_id").agg(F.count("node").alias("n"), F.max("error").alias("error")).orderBy("doc_id").collect()
    complex_page = "preview_document_too_complex"
    assert [(r["n"], r["error"]) for r in found] == [(256, None), (0, complex_page), (50_000, None), (0, complex_page), (1, None)]


def test_texts_inside_and_the_first_node_inside(spark):
    page = "<div class=c><p class=t> a\n<b>b</b> c</p></div><p class=t>out</p><div class=c><i>none</i></div><div class=c><div class=c><p class=t>in</p></div></div>"
    table = nodes.page_nodes(spark.createDataFrame([(1, page)], "doc_id long, html string"))
    cards = nodes.first_inside(table, nodes.signature({"class_tokens": ["c"]}), {"t": nodes.has_class("t")}).orderBy("node")
    assert [(r["node"], r["t"]) for r in cards.collect()] == [(0, 1), (4, None), (6, 8), (7, 8)]
    texts = nodes.inner_texts(table, cards.where("t IS NOT NULL").select("doc_id", F.col("t").alias("node")))
    assert {r["node"]: r["text"] for r in texts.collect()} == {1: "a c b", 8: "in"}
    for said in (None, {}, {"tag": None}, {"class_tokens": "c"}, {"class_tokens": [1]}):
        assert table.where(nodes.signature(said)).count() == 0


def test_semantic_cards_with_provenance_and_warnings(spark):
    found = parsed(spark, [(1, CARDS, "text/html", BASE)])
    assert [(r["title"], r["company"], r["url"], r["location"], r["level"], r["method"], r["confidence"]) for r in found] == [
        ("Intern Engineer Backend", "Example Labs", "https://jobs.example.com/jobs/one", "Hanoi", None, "page_field", 0.82),
        ("Second", "Two", "https://other.example.org/2", None, "senior", "page_field", 0.82),
    ]
    assert found[0]["external_id"] == "one" and found[1]["external_id"] == hashlib.sha256(b"https://other.example.org/2").hexdigest()
    assert [p["path"] for p in found[0]["provenance"]] == [f"html.card[1].{f}" for f in ("title", "company", "url", "external_id", "location")]
    assert found[0]["warnings"] == ["missing_optional:level", "missing_optional:description", "missing_optional:posted_at"]


def test_ways_of_a_page_in_their_order(spark):
    good = '<script type="Application/LD+JSON">{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"H"},"url":"/x"}</script>'
    bad = '<script type="application/ld+json">{"@type":"JobPosting", invalid}</script>'
    found = parsed(spark, [(1, bad + good + CARDS, "text/html", BASE), (2, bad + CARDS + ROWS, "text/html", BASE), (3, bad + ROWS, "application/xhtml+xml; x", BASE), (4, "<p>none</p>", "text/html", BASE)], MAPPING)
    assert [(r["doc_id"], r["method"], r["title"]) for r in found] == [
        (1, "structured_data", "T"), (2, "page_field", "Intern Engineer Backend"), (2, "page_field", "Second"), (3, "manual_mapping", "A"), (3, "manual_mapping", "B"),
    ]
    assert found[3]["url"] == "https://jobs.example.com/jobs/a" and found[3]["provenance"][0]["path"] == "mapping.card[1].title"


def test_bad_records_leave_the_good_ones(spark):
    urls = ["https://[x", "https://a.example:99999/", "https://u:p@a.example/", "http://a.example/", "mailto:x", "https:///p", "", None, "https://A.Example?q=1#f"]
    records = [{"title": "T", "company": "C", "url": u} for u in urls]
    import json

    listed = json.dumps({"@type": "ItemList", "itemListElement": [{"item": dict(records[-1], **{"@type": "JobPosting"})}, {"@type": "JobPosting", **records[-1], "title": 5}, 7, None]})
    rows = "title,company,url\n" + "".join(f"T,C,{u or ''}\n" for u in urls)
    docs = [
        (1, json.dumps({"jobs": [*records, 1, None]}), "application/json", BASE), (2, listed, "text/json", BASE), (3, rows, "text/csv", BASE), (4, "[" * 5000 + "]" * 5000, "application/json", BASE),
        (5, "title,company,url\nT,C,/x\n" + "x" * 70_000 + ",C,/y\n", "text/csv", BASE), (6, 'title,company,url\nT,"C"d,/x\n', "text/csv", BASE), (7, "title,,url\nT,C,/x\n", "text/csv", BASE),
        (8, "", "text/csv", BASE), (9, None, "application/json", BASE), (10, "{}", "image/png", BASE), (11, "{}", None, BASE), (12, "please solve the CAPTCHA", "text/html", BASE),
        (13, "<p>" * 300, "text/html", BASE), (14, json.dumps({"jobs": [records[-1]]}), "application/json", None), (15, '{"jobs": [{"title": "T", "company": "C", "url": "/x"}]}', "application/json", "https://[bad"),
    ]
    found = parsed(spark, docs)
    ok, joined = "https://a.example/?q=1", "https://jobs.example.com/p"
    assert [(r["doc_id"], r["title"], r["url"]) for r in found if r["error"] is None] == [(1, "T", joined), (1, "T", ok), (2, "T", ok), (2, "5", ok), (3, "T", joined), (3, "T", ok), (14, "T", ok)]
    assert {r["doc_id"]: r["error"] for r in found if r["error"]} == {
        5: "preview_csv_invalid", 6: "preview_csv_invalid", 7: "preview_csv_invalid", 8: "preview_csv_invalid", 10: "preview_content_type_unsupported",
        11: "preview_content_type_unsupported", 12: "challenge_detected", 13: "preview_document_too_complex",
    }


def test_descriptions_of_html_and_lines(spark):
    docs = [(1, '{"jobs":[{"title":"T","company":"C","url":"/x","description":"<p>one</p><div class=sidebar>no</div><li>two"},{"title":"T","company":"C","url":"/y","description":" a  b \\n\\n\\n c"}]}', "application/json", BASE)]
    assert [r["description"] for r in parsed(spark, docs)] == ["one\n\n- two", "a b\n\nc"]


def test_pagination_targets(spark):
    link = lambda n: f'<a rel="nofollow NEXT" href="/p{n}">n</a>'
    pages = [
        (1, link(2) + link(2) + '<button class="load-more" data-url="https://x.example/3">m</button><i aria-label="Load More" data-next-url="?p=4"></i>', BASE),
        (2, '<button class="next">dead</button>' + link(2), BASE), (3, '<button class="next" disabled>off</button><a class=next aria-disabled=TRUE></a>' + link(2), BASE),
        (4, "".join(link(n) for n in range(9)) + '<button class="next">late</button>', BASE), (5, "<p>none</p>", BASE), (6, "<p>" * 300, BASE), (7, '<a class=more href="/m"></a>', BASE),
        (8, link("http"), "http://plain.example/"), (9, None, BASE),
    ]
    found = {r["doc_id"]: (r["targets"], r["error"]) for r in candidates.pagination_targets(spark.createDataFrame(pages, "doc_id long, html string, base_url string"), MAPPING).collect()}
    at = "https://jobs.example.com"
    assert found == {
        1: ([f"{at}/p2", "https://x.example/3", f"{at}/list?p=4"], None), 2: (None, "unsupported_interaction"), 3: ([f"{at}/p2"], None), 4: ([f"{at}/p{n}" for n in range(5)], None),
        5: ([], None), 6: (None, "preview_document_too_complex"), 7: ([f"{at}/m"], None), 8: ([], None), 9: ([], None),
    }


def test_structured_text_of_a_page(spark):
    page = "<title>T</title><h1>Head</h1><p>one<br>two</p><ul><li>a<li>b</ul><div class='job related'>gone<p>too</p></div><form>no</form><p id=share>no</p><img>end<style>x</style>"
    got = spark.createDataFrame([(page,)], "h string").select(text.html_to_text(F.col("h"))).first()[0]
    assert re.sub(r"\n+", "|", got) == "T|### Head|one|two|- a|- b|end"


# as deep as pages get whose paragraphs aren't closed
DEEP = '<ul><li><a href="/one">One</a></li></ul>' + "<p><b>text<br>" * 300 + '<i></i></u></b></p><ul><li><a href="/two">Two</a></li></ul>'


def deep_pages(spark, path):
    spark.createDataFrame([(1, "http://Deep.example.com/a", DEEP), (2, "http://flat.example.com/", '<ul><li><a href="/x">X</a></li></ul>')], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_the_query_of_nodes_counts_deep_pages_too(spark, tmp_path):
    found = {(r["page_id"], r["tag"]): r["n"] for r in plans.page_nodes(spark, deep_pages(spark, tmp_path)).collect()}
    assert found == {(1, "ul"): 2, (1, "li"): 2, (1, "a"): 2, (1, "p"): 300, (1, "b"): 300, (1, "br"): 300, (1, "i"): 1, (2, "ul"): 1, (2, "li"): 1, (2, "a"): 1}


def test_pages_without_bounds_and_ends_without_a_start():
    rows, error = nodes.tree("<p>" * 60_000 + "</b>" * 60_000 + "</p>", bounded=False)
    assert error is None and len(rows) == 60_000 and rows[0][2] == rows[-1][2] == 59_999 and rows[-1][3] == 59_999


def test_the_query_of_targets_has_deep_pages_too(spark, tmp_path):
    found = {r["page_id"]: r["targets"] for r in plans.page_targets(spark, deep_pages(spark, tmp_path)).collect()}
    assert found == {1: "https://deep.example.com/one https://deep.example.com/two", 2: "https://flat.example.com/x"}


def test_the_query_of_cards_has_deep_pages_too(spark, tmp_path):
    found = plans.page_cards(spark, deep_pages(spark, tmp_path)).orderBy("page_id", "n").collect()
    assert [(r["page_id"], r["n"], r["title"], r["url"]) for r in found] == [
        (1, 1, "One", "https://deep.example.com/one"), (1, 2, "Two", "https://deep.example.com/two"), (2, 1, "X", "https://flat.example.com/x"),
    ]
