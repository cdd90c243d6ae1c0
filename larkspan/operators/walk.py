"""Walks along listings: pages in the order of their next links, budgets, coverage, and what is new on each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.sources.shared import stored


def ranked_pages(starts: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Rows (listing, page, position, loops) of the pages that each listing's walk reaches.

    ``starts`` has (listing, page), ``links`` (page, next) with one next page at most; a next of null ends the walk.
    Jumps are doubled: round k has, for each page, the page 2**k links on, so that a walk of n pages takes about log2(n)
    rounds of equi joins instead of n. ``position`` counts from 1, up to ``most``; the walk ends before a page that it
    has had, and its last page then ``loops``. Pages without a row in ``links`` end a walk as dead ends do."""
    jumps = stored(links.where("next IS NOT NULL").groupBy("page").agg(F.min("next").alias("to")), "walk-jumps")
    known = stored(starts.select("listing", "page").distinct().withColumn("position", F.lit(0)), "walk-known")
    span = 1
    while span < most:
        # positions 0 .. span - 1 are known: those span links on are the next ones
        ahead = known.join(jumps, "page").select("listing", F.col("to").alias("page"), (F.col("position") + span).alias("position"))
        known = stored(known.unionByName(ahead.where(F.col("position") < most)), "walk-known")
        span *= 2
        if span < most:
            jumps = stored(jumps.join(jumps.select(F.col("page").alias("to"), F.col("to").alias("far")), "to").select("page", F.col("far").alias("to")), "walk-jumps")
    first = known.groupBy("listing", "page").agg(F.min("position").alias("position"))
    # a walk that comes back visits nothing new after its first repetition, so that the first places are all there is
    numbered = first.withColumn("pages", F.count(F.lit(1)).over(Window.partitionBy("listing")))
    last = numbered.where(F.col("position") == F.col("pages") - 1)
    again = last.join(links.groupBy("page").agg(F.min("next").alias("next")), "page").select("listing", F.col("next").alias("page"))
    loops = again.join(first, ["listing", "page"], "left_semi").select("listing").withColumn("loops", F.lit(True))
    out = numbered.join(loops, "listing", "left")
    return out.select("listing", "page", (F.col("position") + 1).alias("position"), (F.coalesce("loops", F.lit(False)) & (F.col("position") == F.col("pages") - 1)).alias("loops"))


def new_on_page(items: DataFrame, scope: str, order: list[str], a: str, b: str) -> DataFrame:
    """``items`` with ``fresh``: whether neither value had been on a fresh item of the scope before, in order.

    An item that is the first of both its values is fresh for sure, and one that shares a value with an earlier fresh
    item is not. Rounds settle the others: those whose earlier sharers are all settled. Each is a window for each value;
    most items need one."""
    numbered = stored(items.withColumn("fresh", F.lit(None).cast("boolean")), "walk-items")
    while True:
        marks = numbered
        for name, value in (("_a", a), ("_b", b)):
            before = Window.partitionBy(scope, value).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            marks = marks.withColumns({f"{name}_taken": F.coalesce(F.bool_or(F.coalesce("fresh", F.lit(False))).over(before), F.lit(False)), f"{name}_open": F.coalesce(F.bool_or(F.col("fresh").isNull()).over(before), F.lit(False))})
        taken, waiting = F.col("_a_taken") | F.col("_b_taken"), F.col("_a_open") | F.col("_b_open")
        settled = F.when(F.col("fresh").isNotNull(), F.col("fresh")).when(taken, False).when(~waiting, True)
        numbered = stored(marks.withColumn("fresh", settled).select(*numbered.columns), "walk-items")
        if numbered.where("fresh IS NULL").isEmpty():
            return numbered


def walk(starts: DataFrame, pages: DataFrame, items: DataFrame, page_budget: int, item_budget: int, allowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The listings' items and reports, as a walk from page to page would find them.

    ``starts`` has (listing, page), ``pages`` (page, next, and error, null where it was read), ``items`` (page, place,
    url, external_id). A listing's walk takes its pages in order. On each page, items whose url or id the listing has
    had are skipped; the item that fills ``item_budget`` ends the walk. It ends too where the next page is one it has
    had, or where ``page_budget`` pages are read. An error of a page, or an item that isn't ``allowed`` (by its columns),
    fails the listing.

    Items: (listing, page, place, url, external_id, position, n). Reports: (listing, pages_found, items_found,
    stop_reason, coverage_complete, error), where stop_reason is end, loop, page_budget or item_budget, and coverage is
    complete where the walk came to the end and has items."""
    plan = stored(ranked_pages(starts, pages.select("page", "next"), page_budget + 1), "walk-pages")
    errors = plan.where(F.col("position") <= page_budget).join(pages.select("page", "error"), "page", "left")
    held = errors.where("error IS NULL").join(items, "page").where("url IS NOT NULL OR external_id IS NOT NULL")
    fresh = new_on_page(held.select("listing", "page", "position", *[c for c in items.columns if c != "page"]), "listing", ["position", "place"], "url", "external_id")
    order = Window.partitionBy("listing").orderBy("position", "place")
    found = stored(fresh.where("fresh").withColumn("n", F.row_number().over(order)).where(F.col("n") <= item_budget).drop("fresh"), "walk-found")
    filled = found.where(F.col("n") == item_budget).select("listing", F.col("position").alias("full_at"))
    good = allowed if allowed is not None else F.lit(True)
    bad_items = found.where(~F.coalesce(good, F.lit(False))).groupBy("listing").agg(F.min(F.struct("position", F.lit(1).alias("step"), F.lit("route_policy_blocked").alias("code"))).alias("bad"))
    bad_pages = errors.where("error IS NOT NULL").groupBy("listing").agg(F.min(F.struct("position", F.lit(0).alias("step"), F.col("error").alias("code"))).alias("bad"))
    bad = bad_items.unionByName(bad_pages).groupBy("listing").agg(F.min("bad").alias("bad"))
    ends = plan.groupBy("listing").agg(F.max("position").alias("reach"), F.bool_or("loops").alias("loops"))
    counts = found.groupBy("listing").agg(F.count(F.lit(1)).alias("items_found"))
    joined = ends.join(filled, "listing", "left").join(bad, "listing", "left").join(counts, "listing", "left")
    read = F.least("reach", F.lit(page_budget))
    stop_at = F.coalesce("full_at", read)
    failed = F.col("bad").isNotNull() & (F.col("bad.position") <= stop_at)
    reason = F.when(F.col("full_at").isNotNull(), "item_budget").when(F.col("reach") > page_budget, "page_budget").when(F.col("loops"), "loop").otherwise("end")
    report = joined.select(
        "listing",
        F.when(failed, F.col("bad.position")).otherwise(stop_at).alias("pages_found"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.coalesce("items_found", F.lit(0).cast("long"))).alias("items_found"),
        F.when(~failed, reason).alias("stop_reason"),
        (~failed & (reason == "end") & (F.coalesce("items_found", F.lit(0)) > 0)).alias("coverage_complete"),
        F.when(failed, F.col("bad.code")).alias("error"),
    )
    lost = report.where("error IS NOT NULL").select("listing")
    return found.join(lost, "listing", "left_anti"), report


def preview(candidates: DataFrame, scope: str, order: list[str], limit: int, least: int = 3) -> DataFrame:
    """Rows (scope, items, error, duplicates): the first ``limit`` items of each scope that are distinct by url and id.

    Items with fewer than ``least`` distinct ones are an error instead. Duplicates count up to the last item kept."""
    if not least <= limit <= 5:
        raise ValueError(f"a preview shows {least} to 5 items")
    fresh = new_on_page(candidates, scope, order, "url", "external_id")
    running = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = fresh.withColumn("_n", F.count_if("fresh").over(running))
    within = counted.where((F.col("_n") < limit) | ((F.col("_n") == limit) & F.col("fresh")))
    shown = within.groupBy(scope).agg(
        F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct("_n", "url", "external_id")))).alias("items"), F.count_if(~F.col("fresh")).alias("duplicates")
    )
    enough = F.size("items") >= least
    return shown.select(
        scope, F.when(enough, F.transform("items", lambda i: F.struct(i["url"].alias("url"), i["external_id"].alias("external_id")))).alias("items"),
        F.when(~enough, "preview_insufficient_jobs").alias("error"), "duplicates",
    )
