"""Registered queries of writes: each writes a table in the shared folder by commits and returns what is in it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.operators import ledger, upserts
from larkspan.plans.queries import query
from larkspan.sources.shared import shared_path
from larkspan.sources.tables import table
from larkspan.sources.versioned import VersionedTable


@query("SELECT event_id, user_id, event_type, value FROM events")
def ledger_replay(spark, d):
    """A stream into a table keyed by event, that stops after its first batch and goes on, and a replay of it all."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    landing = shared_path(spark, "ledger-landing")
    # each event is delivered twice: once as a file of its own third, once in a file of all
    events.repartition(3, "user_id").write.parquet(landing)
    events.coalesce(4).write.mode("append").parquet(landing)
    target = VersionedTable.create(spark, shared_path(spark, "ledger"), events.schema, ["event_id"], buckets=4)
    write = ledger.exactly_once(target, "events", ["event_id"], ["event_id"])

    def stop_after_commit(batch, number):
        write(batch, number)
        raise RuntimeError("stopped after the commit, before the checkpoint")

    checkpoints = shared_path(spark, "ledger-state"), shared_path(spark, "ledger-state")
    for place, sink in ((checkpoints[0], stop_after_commit), (checkpoints[0], write), (checkpoints[1], ledger.exactly_once(target, "replay", ["event_id"], ["event_id"]))):
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(landing)
        run = source.writeStream.foreachBatch(sink).option("checkpointLocation", place).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except Exception:
            if sink is not stop_after_commit:
                raise
    return target.read()


_RESULTS = "SELECT event_id, user_id AS ref, event_type AS kind, value >= 20 AS ok, ts FROM events"


@query(f"""
WITH r AS ({_RESULTS}), w AS (SELECT ref, kind, arg_min(event_id, {{'a': ts, 'b': event_id}}) AS winner FROM r WHERE ok GROUP BY ALL)
SELECT event_id, ok, CASE WHEN ok THEN winner ELSE event_id END AS winner, CASE WHEN ok THEN winner <> event_id ELSE false END AS cached FROM r LEFT JOIN w USING (ref, kind)
""")
def cached_results(spark, d):
    """Accepted results once a key, of two batches in order of time; rejected ones all; each row with its winner."""
    results = table(spark, d, "events").select("event_id", F.col("user_id").alias("ref"), F.col("event_type").alias("kind"), F.expr("coalesce(value >= 20, false)").alias("ok"), "ts")
    target = VersionedTable.create(spark, shared_path(spark, "results"), results.schema, ["ref", "kind"], buckets=4)
    first, last = results.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2).cast("timestamp_ntz")
    for number, part in enumerate((F.col("ts") <= middle, F.col("ts") > middle)):
        ledger.insert_missing(target, results.where(part), ["ref", "kind"], ["ts", "event_id"], F.col("ok"), ("results", number))
    return ledger.winners(target, results, ["ref", "kind"], "event_id", F.col("ok")).select("event_id", "ok", "winner", "cached")


_EARLY = "asked < TIMESTAMP_NTZ '1998-06-01'"


@query("""
WITH q AS (SELECT o_orderkey, o_custkey AS source, o_orderpriority AS key, o_orderstatus AS request_hash, o_orderdate AS asked FROM orders),
old AS (SELECT source, key, arg_min(request_hash, {'a': asked, 'b': o_orderkey}) AS had FROM q WHERE asked < TIMESTAMP '1998-06-01' GROUP BY ALL),
busy AS (SELECT DISTINCT source FROM old WHERE had = 'O'),
k AS (SELECT q.*, had, busy.source IS NOT NULL AS busy FROM q LEFT JOIN old USING (source, key) LEFT JOIN busy USING (source) WHERE asked >= TIMESTAMP '1998-06-01'),
f AS (SELECT source, arg_min({'k': key, 'h': request_hash, 'o': o_orderkey}, {'a': asked, 'b': o_orderkey}) AS f FROM k WHERE had IS NULL AND NOT busy GROUP BY 1)
SELECT o_orderkey, CASE WHEN had IS NOT NULL THEN CASE WHEN had = request_hash THEN 'reused' ELSE 'idempotency_conflict' END WHEN busy THEN 'source_run_active'
  WHEN o_orderkey = f.o THEN 'created' WHEN key = f.k THEN CASE WHEN request_hash = f.h THEN 'reused' ELSE 'idempotency_conflict' END ELSE 'source_run_active' END AS outcome
FROM k LEFT JOIN f USING (source)
""")
def run_requests(spark, d):
    """Customers as sources, priorities as idempotency keys: the orders before a date have made the runs."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("request_hash"), F.col("o_orderdate").alias("asked"))
    made = ledger.first_per_key(orders.where(_EARLY), ["source", "key"], ["asked", "o_orderkey"])
    runs = made.withColumn("status", F.when(F.col("request_hash") == "O", "running").otherwise("succeeded"))
    return ledger.run_requests(orders.where(~F.expr(_EARLY)), runs, ["asked", "o_orderkey"]).select("o_orderkey", "outcome")


@query("""
SELECT p_partkey, p_name, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_size > 25 THEN 'invalidated' ELSE p_type END AS p_type,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_size > 25 THEN coalesce(nullif(p_size, 26), 0) ELSE p_size END AS p_size FROM part
""")
def bulk_rewrite(spark, d):
    """Work of some sources set back where it is active, with a value where there was none; other buckets stay."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    target = VersionedTable.create(spark, shared_path(spark, "rewrite"), parts.schema, ["p_brand"], buckets=8)
    target.append(parts)
    ledger.rewrite(
        target, F.col("p_brand").isin("Brand#1", "Brand#2") & (F.col("p_size") > 25),
        {"p_type": F.lit("invalidated"), "p_size": F.coalesce(F.when(F.col("p_size") != 26, F.col("p_size")), F.lit(0))},
    )
    return target.read().select("p_partkey", "p_name", "p_type", "p_size")


_CONTENT = ["title"]


@query("""
WITH o AS (SELECT l_suppkey AS source, l_partkey AS ext, l_shipdate AS seen, l_orderkey, l_linenumber, l_returnflag || l_linestatus AS title,
  row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem),
b AS (SELECT *, max(seen) OVER w AS newest, arg_max(title, {'a': seen, 'b': -n}) OVER w AS applied FROM o WHERE copies = 1 WINDOW w AS (PARTITION BY source, ext ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, CASE WHEN newest IS NULL THEN 'created' WHEN seen < newest THEN 'stale' WHEN seen = newest THEN CASE WHEN title = applied THEN 'replayed' ELSE 'observation_conflict' END WHEN title = applied THEN 'unchanged' ELSE 'updated' END AS outcome FROM b)
SELECT source AS source_id, CAST(ext AS VARCHAR) AS external_id, arg_max(title, {'a': seen, 'b': -n}) AS title, arg_min(seen, n) AS first_seen, max(seen) AS last_seen, 'active' AS status, 0 AS missed FROM j GROUP BY source, ext
""")
def upserted_jobs(spark, d):
    """Suppliers as sources, their parts as jobs, order lines as observations, written by three runs one after another."""
    lines = table(spark, d, "lineitem")
    schema = spark.createDataFrame([], f"{upserts.STATE}, title string").schema
    target = VersionedTable.create(spark, shared_path(spark, "jobs"), schema, ["job_id"], buckets=8)
    last = lines.agg(F.max("l_orderkey")).first()[0] or 0
    ends = [last // 3, 2 * last // 3]
    for number, part in enumerate((F.col("l_orderkey") <= ends[0], (F.col("l_orderkey") > ends[0]) & (F.col("l_orderkey") <= ends[1]), F.col("l_orderkey") > ends[1])):
        # a line is an observation of its own place
        said = {"l_suppkey": F.col("l_suppkey"), "l_partkey": F.col("l_partkey"), "l_shipdate": F.col("l_shipdate"), "title": F.concat("l_returnflag", "l_linestatus")}
        alone = lines.where(part).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(n) for n, c in said.items()]).where("copies = 1")
        seen = alone.select(
            F.col("l_suppkey").cast("long").alias("source_id"), F.col("l_partkey").cast("string").alias("external_id"), F.concat(F.lit("/"), "l_partkey").alias("canonical_url"),
            F.col("l_shipdate").cast("timestamp").alias("seen_at"), "title", "l_orderkey", "l_linenumber",
        )
        upserts.apply_run(target, seen, ["l_orderkey", "l_linenumber"], _CONTENT, transaction=("runs", number))
    return target.read().select("source_id", "external_id", "title", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "status", "missed")


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_orderstatus, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS retry_of FROM orders WHERE o_custkey % 2 = 0),
up AS (SELECT o_orderkey AS k, o_orderkey AS top, 0 AS d FROM o UNION ALL SELECT up.k, o.retry_of, d + 1 FROM up JOIN o ON o.o_orderkey = up.top WHERE o.retry_of IS NOT NULL)
SELECT top AS o_orderkey, CAST(max(d) AS INTEGER) AS level FROM up GROUP BY top
""")
def purge_order(spark, d):
    """Orders of half of the customers as runs, each a retry of the one before of its customer and priority."""
    before = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    orders = table(spark, d, "orders").where("o_custkey % 2 = 0").withColumn("retry_of", F.lag("o_orderkey").over(before))
    gone, _ = upserts.purge_chains(orders, "o_orderkey", "retry_of", F.lit(True), F.lit(False))
    return gone.select("o_orderkey", F.col("level").cast("int").alias("level"))


@query("""
WITH p AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p))

SELECT 'parent' AS "table", count(*) AS rows FROM p UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_suppkey IN (SELECT c_custkey FROM p)
""")
def purge_cascade(spark, d):
    """Rows that go with the customers of a segment: their orders, and lines by either of two references."""
    parents = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    children = [("orders", table(spark, d, "orders"), [("o_custkey", "parent")], "o_orderkey"), ("lineitem", table(spark, d, "lineitem"), [("l_orderkey", "orders"), ("l_suppkey", "parent")], None)]
    return upserts.cascade(parents, "c_custkey", children)[1]
