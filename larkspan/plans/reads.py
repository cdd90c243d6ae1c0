"""Registered queries of the read path: lists with totals, lookups, semi joins, checks of arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import arrays, jobs, keys, numeric, text, time
from larkspan.operators import identity, listing, search
from larkspan.plans.queries import query
from larkspan.sources.tables import table

_WORDS = "string_split(p_name, ' ')"


@query(f"""
SELECT p_partkey, p_retailprice, total_items, CAST(ceil(total_items / 20) AS BIGINT) AS total_pages FROM (
  SELECT *, count(*) OVER () AS total_items FROM part WHERE p_type = 'ECONOMY' AND list_contains({_WORDS}, 'small'))
ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 20
""")
def list_with_totals(spark, d):
    asked = listing.equal_to(p_brand=None, p_type="ECONOMY") & listing.has_level(F.split("p_name", " "), "small")
    parts = table(spark, d, "part").where(asked).select("p_partkey", "p_retailprice")
    return listing.page_with_totals(parts, ["-p_retailprice", "p_partkey"], 2, 20)


@query("""
SELECT o_orderkey AS id, o_orderdate AS detected_at, o_totalprice, total_items, CAST(ceil(total_items / 50) AS BIGINT) AS total_pages FROM (
  SELECT *, count(*) OVER () AS total_items FROM orders WHERE o_orderstatus = 'F') ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50
""")
def change_list(spark, d):
    changes = table(spark, d, "orders").where(listing.equal_to(o_orderstatus="F")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("detected_at"), "o_totalprice")
    return listing.page_with_totals(changes, listing.ORDERS["changes"], 1, 50)


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def most_recent_candidates(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.col("o_custkey").alias("c_custkey"))
    seen = search.visible(orders, table(spark, d, "customer"), "c_custkey", F.col("c_mktsegment") != "MACHINERY")
    return listing.most_recent(seen, "o_orderdate", "o_orderkey", 20).select("o_orderkey", "o_totalprice")


@query("""
SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (
  SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup') AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 7)
""")
def skill_semi_join(spark, d):
    record = F.from_json("props", "k int")
    results = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), (F.col("event_type").isin("purchase", "signup")).alias("accepted"), F.array(F.struct((record["k"] % 10).alias("name"))).alias("skills"))
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return listing.with_accepted(customers, results, ["c_custkey"], {"accepted": True}, arrays.has_named(F.col("skills"), F.lit(7)))


@query("""
SELECT o_orderkey, o_orderstatus AS status, c_custkey AS customer_id, c_name AS customer_name, CAST(o_totalprice AS DOUBLE) AS amount FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0)
""")
def detail_lookup(spark, d):
    customers = table(spark, d, "customer")
    orders = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    wanted = search.visible(orders, customers, "c_custkey", F.col("c_acctbal") > 0).agg(F.max("o_orderkey")).first()[0]
    row = listing.lookup(orders, "o_orderkey", wanted, customers, "c_custkey", F.col("c_acctbal") > 0).join(customers, "c_custkey")
    detail = row.select(*listing.summary(
        {"o_orderkey": F.col("o_orderkey"), "status": F.col("o_orderstatus")},
        customer={"id": F.col("c_custkey"), "name": F.col("c_name")}, price={"amount": F.col("o_totalprice").cast("double")},
    ))
    return detail.select("o_orderkey", "status", F.col("customer.id").alias("customer_id"), F.col("customer.name").alias("customer_name"), F.col("price.amount").alias("amount"))


@query(f"""
WITH w AS (SELECT p_partkey, {_WORDS} AS w FROM part)
SELECT p_partkey, len(list_filter(w, lambda x: x NOT IN ('small', 'large', 'red', 'blue', 'green', 'widget'))) = 0 AS within, len(w) BETWEEN 2 AND 3 AS bounded,
  array_to_string(list_sort(list_distinct(w)), ',') AS sorted_unique, len(w) <> len(list_distinct(w)) AS repeats,
  CASE WHEN len(list_filter(w, lambda x: x NOT IN ('large', 'small', 'widget', 'gadget'))) = 0 AND len(w) = len(list_distinct(w)) THEN array_to_string(list_filter(['large', 'small', 'widget', 'gadget'], lambda x: list_contains(w, x)), ',') END AS in_order,
  array_to_string(list_transform(w[1:2], lambda x: substr(x, 1, 3)), ',') AS errors FROM w
""")
def array_checks(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", arrays.within(words, ["small", "large", "red", "blue", "green", "widget"]).alias("within"), arrays.bounded(words, 2, 3).alias("bounded"),
        F.array_join(arrays.sorted_unique(words), ",").alias("sorted_unique"), arrays.repeats(words).alias("repeats"),
        F.array_join(arrays.in_order(words, ["large", "small", "widget", "gadget"]), ",").alias("in_order"), F.array_join(arrays.safe_errors(words, 2, 3), ",").alias("errors"),
    )


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE list_contains(json_keys(props), 'k')) AS keyed, count(*) FILTER (WHERE list_contains(json_keys(props), 'all')) AS for_all FROM events GROUP BY 1")
def json_keys(spark, d):
    has = lambda key: F.count_if(arrays.has_key(F.col("props"), key))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), has("k").alias("keyed"), has("all").alias("for_all"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = l_linestatus)")
def current_derived(spark, d):
    lines = table(spark, d, "lineitem").withColumns({"key": F.col("l_orderkey"), "hash": F.col("l_linestatus")})
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("hash"))
    return identity.current(lines, orders, ["key", "hash"], {"l_returnflag": "N"}).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus AND l_returnflag = 'N')")
def missing_versions(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), "l_returnflag")
    return identity.missing(table(spark, d, "orders"), lines, ["o_orderkey", "o_orderstatus"], {"l_returnflag": "N"}).select("o_orderkey")


@query("""
WITH k AS (SELECT l_suppkey AS scope, l_orderkey AS a, l_partkey AS b, l_linenumber AS n FROM lineitem),
j AS (SELECT scope, min(a) AS a, min(b) AS b, scope AS job_id FROM k GROUP BY scope),
h AS (SELECT k.*, x.job_id AS by_a, y.job_id AS by_b, y.a AS other FROM k LEFT JOIN j x ON x.scope = k.scope AND x.a = k.a LEFT JOIN j y ON y.scope = k.scope AND y.b = k.b)
SELECT a AS l_orderkey, n AS l_linenumber, CASE WHEN NOT c THEN coalesce(by_a, by_b) END AS job_id, CASE WHEN c THEN 'identity_conflict' END AS error
FROM (SELECT *, coalesce(by_a <> by_b OR (by_a IS NULL AND by_b IS NOT NULL AND other <> a), false) AS c FROM h)
""")
def resolved_identity(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("external_id"), F.col("l_partkey").alias("canonical_url"), "l_linenumber")
    jobs = lines.groupBy("source_id").agg(F.min("external_id").alias("external_id"), F.min("canonical_url").alias("canonical_url")).withColumn("job_id", F.col("source_id"))
    return identity.resolve(lines, jobs, "l_linenumber").select(F.col("external_id").alias("l_orderkey"), "l_linenumber", "job_id", "error")


@query("""
WITH t AS (SELECT event_id, date_trunc('second', ts) AS said FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN said WHEN 1 THEN said - INTERVAL 7 HOUR END AS moment, CASE event_id % 4 WHEN 2 THEN 'time_without_zone' WHEN 3 THEN 'time_invalid' END AS warning FROM t
""")
def iso_times(spark, d):
    kind = F.col("event_id") % 4
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(kind == 0, "Z").when(kind == 1, "+0700").otherwise(""))
    read = time.iso_utc(F.when(kind == 3, F.concat(F.lit("on "), said)).otherwise(said))
    return table(spark, d, "events").select("event_id", read["at"].alias("moment"), read["warning"].alias("warning"))


@query("""
WITH r AS (SELECT l_orderkey, count(*) AS items, min(epoch_ms(o_orderdate::TIMESTAMP)) AS a, max(epoch_ms(l_shipdate::TIMESTAMP)) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT l_orderkey, b - a AS ms, round(CASE WHEN b > a THEN items * 1000.0 / (b - a) END, 12) AS throughput FROM r
""")
def run_durations(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    runs = table(spark, d, "lineitem").join(orders, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.min("o_orderdate").alias("a"), F.max("l_shipdate").alias("b"))
    ms = time.duration_ms(F.col("a"), F.col("b"))
    return runs.select("l_orderkey", ms.alias("ms"), F.round(numeric.throughput(F.col("items"), ms), 12).alias("throughput"))


_NAMES = ["Python", "k8s", "sql", "Widget  craft", "python"]


@query("""
WITH m AS (SELECT p_partkey, [['python', 'kubernetes', 'sql', 'widget-craft', 'python'][p_partkey % 5 + 1], ['python', 'kubernetes', 'sql', 'widget-craft', 'python'][p_size % 5 + 1]] AS n FROM part)
SELECT p_partkey, CASE WHEN n[1] = n[2] THEN 'rejected' WHEN list_contains(n, 'widget-craft') THEN 'needs_review' ELSE 'accepted' END AS status,
  array_to_string(list_transform(CASE WHEN n[1] = n[2] THEN n[1:1] ELSE n END, lambda x: x || ':' || CASE x WHEN 'python' THEN 'language' WHEN 'kubernetes' THEN 'devops' WHEN 'sql' THEN 'database' ELSE 'other' END), ',') AS skills FROM m
""")
def skill_classes(spark, d):
    names = F.array(*map(F.lit, _NAMES))
    mention = lambda c: F.struct(F.element_at(names, (F.col(c) % 5 + 1).cast("int")).alias("name"), F.lit("required").alias("requirement"))
    found = table(spark, d, "part").select("p_partkey", jobs.classified_skills(F.array(mention("p_partkey"), mention("p_size"))).alias("c"))
    joined = F.array_join(F.transform("c.skills", lambda s: F.concat_ws(":", s["name"], s["category"])), ",")
    return found.select("p_partkey", F.col("c.status").alias("status"), joined.alias("skills"))


@query("SELECT doc_id, sha256(text) AS payload, sha256(lower(source || ' ' || lang)) AS name FROM documents")
def payload_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.payload_hash(F.col("text")).alias("payload"), keys.payload_hash(text.canonical_text(F.concat("source", F.lit("  "), "lang"))).alias("name"))
