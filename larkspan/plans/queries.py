"""The registered queries over the driver's tables, each with SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import jobs, numeric, text, time
from larkspan.operators import alerts, analytics, candidates, catalog, evaluate, health, identity, limits, match, quality, rows, search
from larkspan.sources.shared import shared_path
from larkspan.sources.tables import table
from larkspan.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _skills(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the skills of their latest accepted results."""
    results = table(spark, d, "events").where("event_type <> 'error'")
    latest = rows.latest_per_key(results, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    skills = latest.groupBy(F.col("user_id").alias("c_custkey")).agg(F.collect_set(F.get_json_object("props", "$.k")).alias("skills"))
    return analytics.cohort_skills(table(spark, d, "customer").select("c_custkey"), skills, "c_custkey")


@query("""
WITH r AS (
  SELECT user_id, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type <> 'error'
), s AS (SELECT DISTINCT c_custkey, k FROM r JOIN customer ON c_custkey = user_id WHERE rn = 1),
m AS (SELECT (SELECT count(*) FROM customer) AS cohort, (SELECT count(DISTINCT c_custkey) FROM s) AS analyzed)
SELECT k AS skill, count(*) AS jobs, any_value(cohort) AS cohort, any_value(analyzed) AS analyzed, round_even(count(*) / any_value(cohort), 4) AS share
FROM s CROSS JOIN m GROUP BY k
""")
def skill_frequency(spark, d):
    return analytics.skill_frequency(_skills(spark, d))


def _trend(unit: str):
    def trend(spark, d):
        skills = F.when(F.col("event_type") != "error", F.array("event_type"))
        members = table(spark, d, "events").select("ts", skills.alias("skills"))
        return analytics.skill_trend(members, F.col("ts"), unit, 3)

    return trend


for _unit in ("day", "week", "month"):
    query(f"""
WITH e AS (SELECT CAST(date_trunc('{_unit}', ts) AS DATE) AS bucket, CASE WHEN event_type <> 'error' THEN event_type END AS skill FROM events),
s AS (SELECT bucket, count(*) AS cohort, count(skill) AS analyzed FROM e GROUP BY bucket),
t AS (SELECT skill FROM e WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 3),
c AS (SELECT bucket, skill, count(*) AS n FROM e GROUP BY bucket, skill)
SELECT s.bucket, t.skill, coalesce(n, 0) AS jobs, cohort, analyzed, round_even(analyzed / cohort, 4) AS coverage, round_even(coalesce(n, 0) / cohort, 4) AS share
FROM s CROSS JOIN t LEFT JOIN c ON c.bucket = s.bucket AND c.skill = t.skill
""", f"skill_trend_{_unit}")(_trend(_unit))


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_key(spark, d):
    events = table(spark, d, "events")
    return rows.latest_per_key(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""
SELECT o_orderkey, c_name, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'
ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20
""")
def job_list_page(spark, d):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    listed = table(spark, d, "orders").where("o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'").join(
        table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")
    )
    return rows.page(listed.select("o_orderkey", "c_name", price.alias("price")), "price", "o_orderkey", 2, 20)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'that the') OR contains(lower(source), 'that the')")
def keyword_search(spark, d):
    return search.keyword_search(table(spark, d, "documents"), " That the", ["text", "source"]).select("doc_id", "source")


@query("""
SELECT p_partkey FROM (SELECT p_partkey, p_retailprice AS lo, CASE WHEN p_size > 25 THEN p_retailprice + p_size END AS hi FROM part)
WHERE coalesce(hi, lo) >= 950 AND coalesce(lo, hi) <= 1400
""")
def salary_overlap(spark, d):
    ranged = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), F.when(F.col("p_size") > 25, F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return ranged.where(rows.overlaps(F.col("lo"), F.col("hi"), 950, 1400)).select("p_partkey")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))))
""")
def visible_rows(spark, d):
    nations = search.visible(table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), "r_regionkey", F.col("r_regionkey").isin(1, 2))
    customers = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(nations, "n_nationkey", "left_semi")
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("""
SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)
OR o_custkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)
""")
def observed_by_either_key(spark, d):
    seen = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"))
    return catalog.observed(table(spark, d, "orders"), seen, "o_orderkey", [["o_orderkey"], ["o_custkey"]])


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_derived(spark, d):
    return identity.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], {})


_NEAREST = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a, label AS wanted FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, wanted, label, round(list_cosine_similarity(a, CAST(embedding AS DOUBLE[])), 6) AS relevance FROM q CROSS JOIN embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS position FROM s)
"""


def _nearest(spark, d, top: int) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.nearest(vectors, asked, "vec_id", "embedding", top)


@query(f"WITH {_NEAREST} SELECT query_id, vec_id, relevance, CAST(position AS INTEGER) AS position FROM n WHERE position <= 10")
def semantic_topk(spark, d):
    return _nearest(spark, d, 10)


@query(f"""
WITH {_NEAREST},
a AS (SELECT query_id, sum(CASE WHEN wanted = label THEN 1 ELSE 0 END) AS n FROM s WHERE vec_id <> query_id GROUP BY query_id),
e AS (SELECT query_id, min(CASE WHEN wanted = label THEN position - 1 END) AS first, any_value(a.n) AS n,
  sum(CASE WHEN wanted = label AND position <= 6 THEN 1 ELSE 0 END) AS within FROM n JOIN a USING (query_id) WHERE position BETWEEN 2 AND 21 GROUP BY query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr,
  round(avg(CASE WHEN n = 0 THEN 0.0 ELSE within / n END), 6) AS recall FROM e
""")
def retrieval_evaluation(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    ranked = _nearest(spark, d, 21).where("position > 1").withColumn("position", F.col("position") - 1)
    judged = ranked.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    # a query is one of its own label's rows
    totals = labels.groupBy(F.col("label").alias("wanted")).agg((F.count(F.lit(1)) - 1).alias("total"))
    marked = judged.join(totals, "wanted").withColumn("relevant", F.col("label") == F.col("wanted"))
    return evaluate.retrieval_scores(marked, "query_id", "position", "relevant", total="total")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, 5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rel FROM orders),
g AS (SELECT o_custkey, sum((pow(2.0, rel) - 1) / log2(r + 1)) AS got FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM o) WHERE r <= 5 GROUP BY 1),
i AS (SELECT o_custkey, sum((pow(2.0, rel) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rel DESC, o_orderkey) AS r FROM o) WHERE r <= 5 GROUP BY 1)
SELECT o_custkey, round(CASE WHEN ideal > 0 THEN got / ideal ELSE 0.0 END, 6) AS ndcg FROM g JOIN i USING (o_custkey)
""")
def ndcg_evaluation(spark, d):
    judged = table(spark, d, "orders").withColumn("rel", 5 - F.substring("o_orderpriority", 1, 1).cast("int"))
    return evaluate.ndcg(judged, "o_custkey", "o_orderkey", "o_totalprice", "rel")


def _matches(spark, d) -> DataFrame:
    """One profile against all parts: the words of a part's name are its skills."""
    words = F.split("p_name", " ")
    skills = F.transform(words, lambda w, i: F.struct(w.alias("name"), F.when(i == 0, "required").otherwise("preferred").alias("requirement")))
    part = table(spark, d, "part").withColumns({"skills": F.when(F.col("p_size") % 7 != 0, skills), "least": F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 11)})
    parts = {
        "skill": match.skill_component(F.array(F.lit("small"), F.lit("ring"), F.lit("blue")), F.col("skills")),
        "semantic": F.when(F.col("p_retailprice") <= 2000, match.score4(F.col("p_retailprice").cast("decimal(12,2)") / F.lit(2000).cast("decimal(12,2)"))),
        "experience": match.experience_component(F.lit(5), F.col("least")),
        "location": match.overlap_component(F.array(F.lit("Brand#1"), F.lit("Brand#2")), F.array("p_brand")),
        "role": match.overlap_component(F.array(F.lit("ECONOMY")), F.array("p_type")),
    }
    scored = part.select("p_partkey", *[c.alias(k) for k, c in parts.items()])
    score, coverage = match.overall({k: F.col(k) for k in parts})
    return scored.select("p_partkey", *[F.col(k).cast("double").alias(k) for k in parts], score.cast("double").alias("score"), coverage.cast("double").alias("coverage"))


_MATCHES = """
WITH p AS (SELECT *, string_split(p_name, ' ') AS w, CASE WHEN p_size % 5 <> 0 THEN p_size % 11 END AS least FROM part),
k AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN CAST(round(CAST(list_sum(list_transform(w, lambda x, i: CASE WHEN x IN ('small', 'ring', 'blue') THEN CASE WHEN i = 1 THEN 3 ELSE 2 END ELSE 0 END)) / list_sum(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN 3 ELSE 2 END)) AS DECIMAL(18, 10)), 4) AS DECIMAL(5, 4)) END AS skill,
  CASE WHEN p_retailprice <= 2000 THEN CAST(round(CAST(CAST(p_retailprice AS DECIMAL(12, 2)) / 2000 AS DECIMAL(18, 10)), 4) AS DECIMAL(5, 4)) END AS semantic,
  CASE WHEN least IS NOT NULL THEN CAST(round(CAST(CASE WHEN least = 0 THEN 1.0 ELSE least(1.0, 5.0 / least) END AS DECIMAL(18, 10)), 4) AS DECIMAL(5, 4)) END AS experience,
  CAST(CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1 ELSE 0 END AS DECIMAL(5, 4)) AS location,
  CAST(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS DECIMAL(5, 4)) AS role FROM p),
s AS (SELECT *, CAST(round(coalesce(skill, 0) * 0.40 + coalesce(semantic, 0) * 0.25 + coalesce(experience, 0) * 0.15 + location * 0.10 + role * 0.10, 4) AS DOUBLE) AS score,
  CAST(CASE WHEN skill IS NULL THEN 0.00 ELSE 0.40 END + CASE WHEN semantic IS NULL THEN 0.00 ELSE 0.25 END + CASE WHEN experience IS NULL THEN 0.00 ELSE 0.15 END + 0.20 AS DOUBLE) AS coverage FROM k)
"""


@query(_MATCHES + "SELECT p_partkey, CAST(skill AS DOUBLE) AS skill, CAST(semantic AS DOUBLE) AS semantic, CAST(experience AS DOUBLE) AS experience, CAST(location AS DOUBLE) AS location, CAST(role AS DOUBLE) AS role, score, coverage FROM s")
def match_scores(spark, d):
    return _matches(spark, d)


@query(_MATCHES + "SELECT p_partkey, score FROM s ORDER BY score DESC, p_partkey LIMIT 100")
def match_top100(spark, d):
    return match.top_matches(_matches(spark, d), "score", "p_partkey").select("p_partkey", "score")


@query("""
WITH n AS (SELECT *, l_returnflag || l_linestatus AS content, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
b AS (SELECT *, max(l_shipdate) OVER w AS newest, arg_max(content, {'a': l_shipdate, 'b': -n}) OVER w AS applied FROM n
  WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_orderkey, l_linenumber, CASE WHEN newest IS NULL THEN 'created' WHEN l_shipdate < newest THEN 'stale'
  WHEN l_shipdate = newest THEN CASE WHEN content = applied THEN 'replayed' ELSE 'conflict' END WHEN content = applied THEN 'unchanged' ELSE 'updated' END AS outcome FROM b
""")
def upsert_outcomes(spark, d):
    observations = table(spark, d, "lineitem").withColumn("content", F.concat("l_returnflag", "l_linestatus"))
    done = catalog.observation_outcomes(observations, ["l_partkey", "l_suppkey"], "l_shipdate", ["l_orderkey", "l_linenumber"], "content")
    return done.select("l_orderkey", "l_linenumber", "outcome")


@query("""
WITH v AS (SELECT *, row_number() OVER w AS n, lag(l_returnflag) OVER w AS f0, lag(l_linestatus) OVER w AS s0 FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, 'l_returnflag' AS field, f0 AS old_value, l_returnflag AS new_value FROM v WHERE n > 1 AND f0 IS DISTINCT FROM l_returnflag
UNION ALL SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, 'l_linestatus', s0, l_linestatus FROM v WHERE n > 1 AND s0 IS DISTINCT FROM l_linestatus
""")
def change_log(spark, d):
    logged = catalog.change_log(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])
    return logged.drop("l_shipdate")


@query("""
WITH s AS (SELECT DISTINCT s_nationkey, s_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS run FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
r AS (SELECT s_nationkey, run, row_number() OVER (PARTITION BY s_nationkey ORDER BY run) AS n FROM (SELECT DISTINCT s_nationkey, run FROM s)),
g AS (SELECT f.s_nationkey, f.s_suppkey, r.run, r.n, (s.run IS NOT NULL)::INT AS seen FROM (SELECT s_nationkey, s_suppkey, min(run) AS first FROM s GROUP BY 1, 2) f
  JOIN r ON r.s_nationkey = f.s_nationkey AND r.run >= f.first LEFT JOIN s ON s.s_nationkey = f.s_nationkey AND s.s_suppkey = f.s_suppkey AND s.run = r.run),
i AS (SELECT *, sum(seen) OVER (PARTITION BY s_nationkey, s_suppkey ORDER BY n) AS island FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, s_suppkey, island ORDER BY n) - 1 AS missed FROM i)
SELECT s_nationkey, s_suppkey, run, CASE missed WHEN 0 THEN 'active' WHEN 1 THEN 'missing' ELSE 'removed' END AS status, CAST(missed AS INTEGER) AS missed FROM m
""")
def absence_lifecycle(spark, d):
    seen = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "s_suppkey", time.bucket_start(F.col("l_shipdate"), "month").alias("run")).distinct()
    return catalog.absence_lifecycle(seen, seen.select("s_nationkey", "run"), "s_nationkey", "run", "s_suppkey")


def _runs(spark, d) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey", time.bucket_start(F.col("o_orderdate"), "month").alias("run")).agg(F.count(F.lit(1)).alias("items"))


_RUNS = "r AS (SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS run, count(*) AS items FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"""
WITH {_RUNS}, b AS (SELECT *, CAST(floor(median(items) OVER w) AS BIGINT) AS baseline, count(items) OVER w AS earlier FROM r
  WINDOW w AS (PARTITION BY c_nationkey ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT c_nationkey, run, items, baseline, earlier, coalesce(earlier >= 2 AND items < baseline * 0.5, false) AS dropped FROM b
""")
def inventory_drops(spark, d):
    return health.inventory_drops(_runs(spark, d), "c_nationkey", ["run"], "items")


@query(f"""
WITH {_RUNS}, f AS (SELECT *, (items % 3 = 0)::INT AS failed FROM r),
i AS (SELECT *, sum(1 - failed) OVER (PARTITION BY c_nationkey ORDER BY run) AS island FROM f),
s AS (SELECT *, sum(failed) OVER (PARTITION BY c_nationkey, island ORDER BY run) AS streak FROM i)
SELECT c_nationkey, run, CAST(streak AS BIGINT) AS streak, CASE WHEN items % 30 = 0 THEN 'quarantined' WHEN streak >= 3 THEN 'unhealthy' WHEN streak > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM s
""")
def source_health(spark, d):
    failed = health.failure_streaks(_runs(spark, d), "c_nationkey", ["run"], F.col("items") % 3 == 0)
    return failed.select("c_nationkey", "run", "streak", health.status(F.col("streak"), F.col("items") % 30 == 0).alias("status"))


@query("""
WITH c AS (SELECT o_orderkey, sha256(concat_ws('|', 'alert:v1', 'rule7', CAST(o_orderkey AS VARCHAR), o_orderpriority)) AS key FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE contains(lower(c_mktsegment), 'mach') AND o_totalprice >= 100000),
l AS (SELECT sha256(concat_ws('|', 'alert:v1', 'rule7', CAST(o_orderkey AS VARCHAR), o_orderpriority)) AS key, CASE WHEN o_orderstatus = 'F' THEN 'sent' ELSE 'pending' END AS status,
  o_orderkey % 4 AS attempts, o_orderdate AS tried_at FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, c.key, CASE WHEN status = 'sent' THEN 'sent' WHEN status = 'pending' AND tried_at > TIMESTAMP '1999-01-01' - INTERVAL 10 MINUTE THEN 'pending'
  WHEN attempts >= 3 THEN 'exhausted' ELSE 'claim' END AS decision,
  CASE WHEN (status = 'sent' OR (status = 'pending' AND tried_at > TIMESTAMP '1999-01-01' - INTERVAL 10 MINUTE) OR attempts >= 3) IS NOT TRUE THEN coalesce(attempts, 0) + 1 END AS attempt
FROM c LEFT JOIN l ON l.key = c.key
""")
def delivery_claims(spark, d):
    key = alerts.delivery_key(F.lit("rule7"), F.col("o_orderkey"), F.col("o_orderpriority"))
    orders = table(spark, d, "orders")
    wanted = orders.join(table(spark, d, "customer").where(text.contains_text(F.col("c_mktsegment"), "mach")), F.col("o_custkey") == F.col("c_custkey"), "left_semi").where("o_totalprice >= 100000")
    ledger = orders.where("o_orderkey % 2 = 0").select(key.alias("key"), F.when(F.col("o_orderstatus") == "F", "sent").otherwise("pending").alias("status"), (F.col("o_orderkey") % 4).alias("attempts"), F.col("o_orderdate").alias("tried_at"))
    return alerts.claim_deliveries(wanted.select("o_orderkey", key.alias("key")), ledger, "key", F.lit("1999-01-01").cast("timestamp")).select("o_orderkey", "key", "decision", "attempt")


@query("""
SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS hash FROM part
""")
def content_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", catalog.content_hash(["p_name", "p_brand", "p_size", "p_partkey"]).alias("hash"))


@query("""
SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g')) AS hash,
  regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS changed FROM documents
""")
def redact_emails(spark, d):
    clean = text.redact_emails(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(clean, 256).alias("hash"), (clean != F.col("text")).alias("changed"))


_PHONE = r"(^|[^0-9])(?:\+84|0)(?:[ .()-]*[0-9]){9}([^0-9]|$)"


# a number's neighbours are matched too, so that the second pass finds what shares one
@query(rf"""
WITH e AS (SELECT doc_id, text, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[redacted-email]', 'g') AS t FROM documents),
p AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, '{_PHONE}', '\1[redacted-phone]\2', 'g'), '{_PHONE}', '\1[redacted-phone]\2', 'g') AS t FROM e)
SELECT doc_id, sha256(t) AS hash, t <> text AS changed FROM p
""")
def redact_contacts(spark, d):
    clean = text.redact_contacts(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(clean, 256).alias("hash"), (clean != F.col("text")).alias("changed"))


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
  array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref')), '&') AS kept FROM u)
SELECT page_id, 'https://' || host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url, host FROM p
""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"), text.host_of(F.col("url")).alias("host"))


@query(r"""
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages
""")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query()
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query()
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("hash"), F.length(text.normalize_multiline(F.col("text"))).alias("length"))


@query()
def first_wins_dedup(spark, d):
    return limits.first_wins(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")


@query("""
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS p95_linear, quantile_disc(l_extendedprice, 0.95) AS p95_nearest, quantile_cont(l_extendedprice, 0.5) AS p50 FROM lineitem GROUP BY 1
""")
def percentiles(spark, d):
    found = evaluate.percentiles(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")
    return found.select("l_returnflag", F.col("linear").alias("p95_linear"), F.col("nearest").alias("p95_nearest"), F.col("median").alias("p50"))


@query("SELECT event_id, to_timestamp(floor(epoch(date_trunc('second', ts)) / 900) * 900)::TIMESTAMP AS slot FROM events")
def schedule_slots(spark, d):
    return table(spark, d, "events").select("event_id", time.interval_slot(F.col("ts"), 15).cast("timestamp").alias("slot"))


@query("""
SELECT event_id, round(least(greatest(2.0 * pow(2.0, event_id % 5) * (1 + (2 * ((event_id % 100) / 100) - 1) * 0.25), coalesce(CASE WHEN event_id % 7 = 0 THEN value END, 0.0)), 20.0), 6) AS seconds FROM events
""")
def retry_backoff(spark, d):
    delay = numeric.backoff_seconds(F.col("event_id") % 5 + 1, 2.0, (F.col("event_id") % 100) / 100, 0.25, F.when(F.col("event_id") % 7 == 0, F.col("value")), 20.0)
    return table(spark, d, "events").select("event_id", F.round(delay, 6).alias("seconds"))


@query()
def rate_limit(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("seconds", F.col("us") / 1e6)
    return limits.fixed_window_limit(events, "user_id", "seconds", "event_id", 86400, 3)


@query("""
SELECT 'quantity' AS "check", count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 49)) AS violations FROM lineitem
UNION ALL SELECT 'discount', count(*) FILTER (WHERE NOT (l_discount < 0.1)) FROM lineitem
UNION ALL SELECT 'duplicate lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lines without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def quality_checks(spark, d):
    lines, orders, customers = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return quality.report(
        quality.check_violations(lines, {"quantity": F.col("l_quantity").between(1, 49), "discount": F.col("l_discount") < 0.1}),
        quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], "duplicate lines"),
        quality.orphans(lines, orders, "l_orderkey", "o_orderkey", "lines without order"),
        quality.orphans(orders, customers, "o_custkey", "c_custkey", "orders without customer"),
    )


@query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'parent' AS "table", count(*) AS rows FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
""")
def purge_counts(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return catalog.purge_counts(table(spark, d, "customer").where("c_acctbal < 0"), [("orders", orders, "o_custkey"), ("lineitem", table(spark, d, "lineitem"), "l_orderkey")], "c_custkey")


@query("""
WITH r AS (SELECT l.doc_id, CASE WHEN regexp_matches(text, '(!!|[$%&*#]{3})') THEN 1 ELSE 0 END AS found, 1 - quality AS wanted FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
s AS (SELECT sum(found * wanted) AS tp, sum(found) AS f, sum(wanted) AS w FROM r)
SELECT round(CASE WHEN f = 0 THEN 0.0 ELSE tp / f END, 6) AS precision, round(CASE WHEN w = 0 THEN 0.0 ELSE tp / w END, 6) AS recall, round(CASE WHEN f + w = 0 THEN 0.0 ELSE 2 * tp / (f + w) END, 6) AS f1 FROM s
""")
def extraction_baseline(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    junk = lambda c: F.when(c, F.array(F.lit("junk"))).otherwise(F.array().cast("array<string>"))
    return joined.select(junk(F.col("text").rlike("(!!|[$%&*#]{3})")).alias("found"), junk(F.col("quality") == 0).alias("wanted")).agg(*evaluate.extraction_scores(F.col("found"), F.col("wanted")))


@query("""
SELECT c_custkey, first_seen, last_seen, n FROM (SELECT o_custkey AS c_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, count(*) AS n FROM orders GROUP BY 1)
""")
def first_and_last_seen(spark, d):
    return catalog.sightings(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_orderdate")


def _streamed(spark, d: str, name: str, transform) -> DataFrame:
    """All of a table as a stream, through a stateful operator into a table in the shared folder."""
    # a pattern, as a table may be one file or a folder
    source = spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")
    out, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    result = transform(source)
    run = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


@query(ORACLE_SQL["upsert_outcomes"].replace("PARTITION BY l_partkey, l_suppkey", "PARTITION BY l_suppkey"))
def stream_upsert_outcomes(spark, d):
    key, at = F.col("l_suppkey"), F.col("l_shipdate")
    place = F.concat_ws(":", F.lpad(F.col("l_orderkey").cast("string"), 20, "0"), F.lpad(F.col("l_linenumber").cast("string"), 10, "0"))
    seen = lambda s: s.select(key.alias("key"), at.alias("at"), place.alias("place"), F.concat("l_returnflag", "l_linestatus").alias("content"))
    done = _streamed(spark, d, "lineitem", lambda s: state.stream_outcomes(seen(s), "key", "at", "place", "content"))
    part = lambda k: F.split("place", ":")[k]
    return done.select(part(0).cast("long").alias("l_orderkey"), part(1).cast("int").alias("l_linenumber"), "outcome")


@query()
def text_facts(spark, d):
    body = F.col("text")
    facts = table(spark, d, "documents").select(
        "doc_id", F.size(jobs.levels(body)).alias("levels"), jobs.location(body)["work_mode"].alias("work_mode"), F.size(jobs.skills(F.col("source"), body)).alias("skills"),
        jobs.role(F.col("source"), body)["role"].alias("role"), jobs.experience(body)["warnings"].alias("experience"),
        jobs.salary(body)["warnings"].alias("salary"),
    )
    return facts


@query("""
SELECT p_partkey AS doc_id, 'structured_json' AS method, p_name AS title, p_brand AS company, 'https://shop.example.com/p/' || p_partkey AS url, CAST(p_partkey AS VARCHAR) AS external_id, p_type AS location, 0.9 AS confidence FROM part
""")
def document_candidates(spark, d):
    record = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.concat(F.lit("/p/"), "p_partkey").alias("url"), F.col("p_partkey").alias("id"), F.col("p_type").alias("location"))
    documents = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(F.array(record).alias("jobs"))).alias("payload"), F.lit("application/json").alias("content_type"), F.lit("https://shop.example.com/list").alias("base_url")
    )
    return candidates.parse_documents(documents).drop("level", "description", "posted_at", "place", "provenance", "warnings")


@query("""
SELECT n_regionkey, segment, orders, customers FROM (
  SELECT n_regionkey, c_mktsegment AS segment, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
""")
def run_counters(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_regionkey", F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers"))


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey, count(o_orderkey) AS open_orders, round(coalesce(sum(o_totalprice), 0.0), 2) AS open_price FROM customer LEFT JOIN v ON o_custkey = c_custkey GROUP BY 1
""")
def left_join_denominator(spark, d):
    open_orders = table(spark, d, "orders").where("o_orderstatus = 'O'").withColumnRenamed("o_custkey", "c_custkey")
    totals = analytics.with_totals(table(spark, d, "customer").select("c_custkey"), open_orders, "c_custkey", "o_totalprice")
    return totals.select("c_custkey", F.col("n").alias("open_orders"), F.round("total", 2).alias("open_price"))


@query(r"""
WITH p AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
  list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
m AS (SELECT host, count(*) AS pages, min(s) AS a, max(s) AS b FROM p GROUP BY host)
SELECT host, pages, '/' || array_to_string(a[1:len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))], '/') AS prefix FROM m
""")
def path_prefix(spark, d):
    pages = table(spark, d, "pages").select(text.host_of(F.col("url")).alias("host"), text.path_segments(F.col("url")).alias("s"))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), text.common_prefix(F.col("s")).alias("prefix"))


@query("""
WITH r AS (SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS run, count(*) AS items, count(*) FILTER (WHERE o_orderstatus = 'F') AS processed,
  count(*) FILTER (WHERE o_totalprice > 400000) AS failed FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, run, CASE WHEN failed = 0 THEN 'succeeded' WHEN processed > 0 THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN failed = 0 AND items > 0 AND processed > 0 THEN 'complete' ELSE 'incomplete' END AS coverage FROM r
""")
def finalized_runs(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = joined.groupBy("c_nationkey", time.bucket_start(F.col("o_orderdate"), "month").alias("run")).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"), F.count_if(F.col("o_totalprice") > 400000).alias("failed")
    )
    status, coverage = health.finalized(F.col("failed") > 0, F.col("processed"), F.col("items"), F.col("processed") > 0)
    return runs.select("c_nationkey", "run", status.alias("status"), coverage.alias("coverage"))
