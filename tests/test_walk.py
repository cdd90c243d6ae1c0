import random

from pyspark.sql import functions as F

from larkspan.operators import walk

PAGES = "page string, next string, error string"
ITEMS = "page string, place int, url string, external_id string"


def by_hand(starts, pages, items, page_budget, item_budget, allowed=lambda url: True):
    """The walk as a loop over pages."""
    reports, kept = {}, {}
    for listing, start in starts:
        page, visited, urls, ids, found, complete, reason, error = start, [], set(), set(), [], True, "end", None
        while page is not None:
            if page in visited or len(visited) >= page_budget:
                complete, reason = False, "loop" if page in visited else "page_budget"
                break
            visited.append(page)
            following, bad = pages.get(page, (None, None))
            if bad:
                error = bad
                break
            for place, url, key in sorted(items.get(page, []), key=lambda i: i[0]):
                if url in urls or key in ids:
                    continue
                if not allowed(url):
                    error = "route_policy_blocked"
                    break
                urls.add(url)
                ids.add(key)
                found.append((page, place))
                if len(found) >= item_budget:
                    complete, reason = False, "item_budget"
                    break
            if error or not complete:
                break
            page = following
        reports[listing] = (len(visited), 0 if error else len(found), None if error else reason, not error and complete and bool(found), error)
        kept[listing] = [] if error else found
    return reports, kept


def check(spark, starts, pages, items, page_budget, item_budget, allowed=None):
    flat = [(p, n, u, k) for p, row in items.items() for n, u, k in row]
    found, report = walk.walk(
        spark.createDataFrame(starts, "listing string, page string"), spark.createDataFrame([(p, *v) for p, v in pages.items()], PAGES), spark.createDataFrame(flat, ITEMS),
        page_budget, item_budget, allowed and allowed(F.col("url")),
    )
    reports, kept = by_hand(starts, pages, items, page_budget, item_budget, (lambda u: "bad" not in u) if allowed else (lambda u: True))
    assert {r["listing"]: tuple(r)[1:] for r in report.collect()} == reports
    rows = {}
    for r in found.orderBy("listing", "n").collect():
        rows.setdefault(r["listing"], []).append((r["page"], r["place"]))
    assert rows == {k: v for k, v in kept.items() if v}
    return reports


def test_ends_loops_budgets_and_errors(spark):
    pages = {"a1": ("a2", None), "a2": ("a3", None), "a3": (None, None), "l1": ("l2", None), "l2": ("l3", None), "l3": ("l2", None), "s": ("s", None), "e1": ("e2", None), "e2": (None, "preview_html_invalid"), "x": ("y", None), "empty": (None, None)}
    items = {"a1": [(0, "u1", "1"), (1, "u2", "2")], "a2": [(0, "u2", "9"), (1, "u9", "1"), (2, "u3", "3")], "a3": [(0, "u9", "9")], "l1": [(0, "u1", "1")], "l2": [(0, "u2", "2")], "l3": [(0, "u3", "3")], "s": [(0, "u", "1")], "e1": [(0, "u", "1")], "x": [(0, "bad", "1")]}
    starts = [("A", "a1"), ("L", "l1"), ("S", "s"), ("E", "e1"), ("X", "x"), ("N", "empty"), ("A2", "a2")]
    reports = check(spark, starts, pages, items, 10, 100)
    assert reports["A"] == (3, 4, "end", True, None) and reports["L"] == (3, 3, "loop", False, None) and reports["E"][4] == "preview_html_invalid" and reports["N"] == (1, 0, "end", False, None)
    check(spark, starts, pages, items, 2, 100)
    check(spark, starts, pages, items, 10, 3)
    check(spark, starts, pages, items, 1, 1, lambda url: url != "bad")


def test_against_a_loop_on_random_listings(spark):
    pick = random.Random(8)
    names = [f"p{i}" for i in range(60)]
    pages = {p: (pick.choice(names) if pick.random() < 0.9 else None, None) for p in names}
    items = {p: [(i, f"u{pick.randrange(150)}", f"k{pick.randrange(150)}") for i in range(pick.randrange(6))] for p in names}
    starts = [(f"L{i}", pick.choice(names)) for i in range(25)]
    check(spark, starts, pages, items, 7, 12)


def test_long_chains_take_few_rounds(spark):
    links = spark.createDataFrame([(f"p{i:04d}", f"p{i + 1:04d}") for i in range(300)], "page string, next string")
    found = walk.ranked_pages(spark.createDataFrame([("L", "p0000")], "listing string, page string"), links, 200).orderBy("position").collect()
    assert [(r["page"], r["position"]) for r in found] == [(f"p{i:04d}", i + 1) for i in range(200)]


def test_previews(spark):
    rows = [("a", i, f"u{i // 2}", f"k{i}") for i in range(9)] + [("b", 0, "u", "k"), ("b", 1, "u", "z"), ("b", 2, "v", "k"), ("b", 3, "w", "w")]
    frame = spark.createDataFrame(rows, "doc string, place int, url string, external_id string")
    found = {r["doc"]: (r["items"] and [i["url"] for i in r["items"]], r["error"], r["duplicates"]) for r in walk.preview(frame, "doc", ["place"], 3).collect()}
    assert found == {"a": (["u0", "u1", "u2"], None, 2), "b": (None, "preview_insufficient_jobs", 2)}
