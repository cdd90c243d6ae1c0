"""Registered queries of the write path: upserts with all outcomes, run counters, health, match reports, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import catalog, evaluate, health, match
from larkspan.plans.queries import _MATCHES, _RUNS, _matches, _runs, query
from larkspan.sources.tables import table

_OUTCOMES = """
n AS (SELECT *, l_returnflag || l_linestatus AS content, l_returnflag AS old, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
b AS (SELECT *, max(l_shipdate) OVER w AS newest, arg_max(content, {'a': l_shipdate, 'b': -n}) OVER w AS applied, arg_max(l_linestatus, {'a': l_shipdate, 'b': -n}) OVER w AS said FROM n
  WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE WHEN newest IS NULL THEN 'created' WHEN l_shipdate < newest THEN 'stale' WHEN l_shipdate = newest THEN CASE WHEN content = applied OR old = applied THEN 'replayed' ELSE 'conflict' END
  WHEN date_diff('day', CAST(newest AS DATE), CAST(l_shipdate AS DATE)) > 365 THEN 'reactivated' WHEN content = applied OR (old = applied AND l_linestatus = said) THEN 'unchanged' ELSE 'updated' END AS outcome FROM b)
"""


def _outcomes(spark, d):
    observed = table(spark, d, "lineitem").withColumns({"content": F.concat("l_returnflag", "l_linestatus"), "old": F.col("l_returnflag")})
    days = lambda newest: F.datediff("l_shipdate", newest)
    away = lambda newest: F.when(days(newest) > 730, "removed").when(days(newest) > 365, "missing")
    return catalog.observation_outcomes(observed, ["l_partkey", "l_suppkey"], "l_shipdate", ["l_orderkey", "l_linenumber"], "content", away, ("old", "l_linestatus"))


@query(f"WITH {_OUTCOMES} SELECT l_orderkey, l_linenumber, outcome FROM o")
def upsert_with_reactivation(spark, d):
    return _outcomes(spark, d).select("l_orderkey", "l_linenumber", "outcome")


@query(f"""
WITH {_OUTCOMES} SELECT l_suppkey, count(*) AS considered, {', '.join(f"count(*) FILTER (WHERE outcome = '{v}') AS {k}" for k, v in catalog.COUNTERS.items())} FROM o GROUP BY 1
""")
def outcome_counters(spark, d):
    return catalog.run_counters(_outcomes(spark, d), ["l_suppkey"])


@query(f"""
WITH {_OUTCOMES} SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, 'status' AS field, CASE WHEN outcome = 'reactivated' THEN CASE WHEN date_diff('day', CAST(newest AS DATE), CAST(l_shipdate AS DATE)) > 730 THEN 'removed' ELSE 'missing' END END AS old_value, 'active' AS new_value FROM o WHERE outcome IN ('created', 'reactivated')
""")
def status_changes(spark, d):
    return catalog.status_changes(_outcomes(spark, d), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


_CODE = "CASE items % 11 WHEN 0 THEN 'network_timeout' WHEN 1 THEN 'policy_blocked' WHEN 2 THEN 'persistence_failed' WHEN 3 THEN 'layout_changed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'rate_limited' END"


@query(f"""
WITH RECURSIVE {_RUNS}, c AS (SELECT *, {_CODE} AS code, items - 60 * (items % 7 // 6) AS found, row_number() OVER (PARTITION BY c_nationkey ORDER BY run) AS n FROM r),
s AS (
  SELECT c_nationkey, CAST(NULL AS DATE) AS run, CAST(0 AS BIGINT) AS n, 'healthy' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS signal, 0 AS failures, CAST([] AS BIGINT[]) AS counts, false AS complete FROM c GROUP BY 1
  UNION ALL
  SELECT c_nationkey, run, n, CASE WHEN dropped THEN 'degraded' WHEN code IS NULL THEN 'healthy' WHEN code = 'cancelled' THEN status WHEN code = 'policy_blocked' THEN 'quarantined'
      WHEN code IN ('network_timeout', 'rate_limited') THEN CASE WHEN failures >= 2 THEN 'unhealthy' ELSE 'degraded' END WHEN code = 'persistence_failed' THEN 'unhealthy' WHEN failures >= 1 THEN 'quarantined' ELSE 'degraded' END,
    CASE WHEN dropped THEN 'inventory_drop_anomaly' ELSE code END,
    CASE WHEN dropped THEN 'inventory_drop_anomaly' WHEN code IS NULL THEN CASE WHEN status <> 'healthy' THEN 'source_recovered' END ELSE code END,
    CASE WHEN dropped THEN failures + 1 WHEN code IS NULL THEN 0 WHEN code = 'cancelled' THEN failures ELSE failures + 1 END,
    CASE WHEN code IS NULL AND NOT dropped THEN list_append(counts, found) ELSE counts END, code IS NULL AND NOT dropped
  FROM (SELECT c.c_nationkey, c.run, c.n, c.code, c.found, s.status, s.failures, s.counts,
      c.code IS NULL AND len(s.counts) >= 2 AND coalesce(c.found < floor(list_aggregate(s.counts[-5:], 'median')) * 0.5, false) AS dropped FROM s JOIN c ON c.c_nationkey = s.c_nationkey AND c.n = s.n + 1)
)
SELECT c_nationkey, run, status, reason, signal, CAST(failures AS INTEGER) AS failures, complete FROM s WHERE n > 0
""")
def health_machine(spark, d):
    runs = _runs(spark, d).withColumns({"code": F.expr(_CODE), "found": F.expr("items - 60 * (items % 7 div 6)")})
    return health.health_machine(runs, "c_nationkey", "run", "found", "code")


@query(_MATCHES + """
SELECT p_partkey, concat_ws(',', CASE WHEN skill IS NULL THEN 'skill_unavailable' WHEN skill = 1 THEN 'skill_complete' WHEN skill > 0 THEN 'skill_partial' ELSE 'skill_no_match' END,
  CASE WHEN semantic IS NULL THEN 'semantic_unavailable' ELSE 'semantic_available' END,
  CASE WHEN experience IS NULL THEN 'experience_unavailable' WHEN experience = 1 THEN 'experience_meets_minimum' ELSE 'experience_below_minimum' END,
  CASE WHEN location = 1 THEN 'location_match' ELSE 'location_mismatch' END, CASE WHEN role = 1 THEN 'role_match' ELSE 'role_mismatch' END) AS explanation FROM s
""")
def match_explanations(spark, d):
    parts = [F.col(k) for k in ("skill", "semantic", "experience", "location", "role")]
    return _matches(spark, d).select("p_partkey", F.array_join(match.explanation(*parts), ",").alias("explanation"))


@query(_MATCHES + """
, t AS (SELECT p_partkey FROM s ORDER BY score DESC, p_partkey LIMIT 100)
SELECT (SELECT count(*) FROM s) AS considered, (SELECT count(*) FROM s WHERE skill IS NOT NULL) AS available, (SELECT count(*) FROM s WHERE skill IS NULL) AS unavailable,
  (SELECT count(*) FROM t) AS stored, (SELECT count(*) FROM t WHERE p_partkey % 3 <> 0) AS created, (SELECT count(*) FROM t WHERE p_partkey % 3 = 0) AS reused
""")
def match_report(spark, d):
    scored = _matches(spark, d)
    existing = table(spark, d, "part").where("p_partkey % 3 = 0")
    return match.generation_report(scored, match.top_matches(scored, "score", "p_partkey"), existing, "p_partkey", F.col("skill").isNotNull())


@query("SELECT p_partkey, CASE WHEN p_retailprice / 1500 BETWEEN 0 AND 1 THEN CAST(round(CAST(p_retailprice / 1500 AS DECIMAL(20, 10)), 4) AS DOUBLE) END AS semantic FROM part")
def semantic_component(spark, d):
    return table(spark, d, "part").select("p_partkey", match.semantic_component(F.col("p_retailprice") / 1500).cast("double").alias("semantic"))


@query("""
WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1),
v AS (SELECT l_returnflag, v[CAST(greatest(floor(0.95 * len(v)), 1) AS BIGINT)] AS v FROM s)
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 6) AS linear, quantile_disc(l_extendedprice, 0.95) AS nearest, any_value(v) AS floor, round(median(l_extendedprice), 6) AS median, max(l_extendedprice) AS most
FROM lineitem JOIN v USING (l_returnflag) GROUP BY 1
""")
def percentiles_by_rank(spark, d):
    found = evaluate.percentiles_by_rank(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return found.withColumns({c: F.round(c, 6) for c in ("linear", "median")})


@query("""
WITH k AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS event_type)
SELECT event_type, count(event_id) AS n FROM k LEFT JOIN events USING (event_type) GROUP BY 1
""")
def zero_filled_counts(spark, d):
    return evaluate.counts_of(table(spark, d, "events"), "event_type", ["click", "error", "purchase", "refund", "signup", "view"])
