"""Registered queries of landing and backfill."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from larkspan.operators import landing
from larkspan.plans.queries import query
from larkspan.sources.tables import table

_TYPES = ["text/html; charset=utf-8", "text/plain; charset=us-ascii", "application/json", "image/png", "text/csv; charset=x-none", "text/plain; charset=\"latin-1\""]


@query(f"""
WITH p AS (SELECT page_id, ['{"', '".join(_TYPES)}'][page_id % 6 + 1] AS kind, html FROM pages)
SELECT page_id, sha256(html) AS raw_hash, CASE WHEN kind = 'image/png' THEN 'unsupported_text_content' WHEN kind LIKE '%x-none' THEN 'unsupported_charset'
  WHEN kind LIKE '%ascii' AND regexp_matches(html, '[^\\x00-\\x7F]') THEN 'invalid_text_encoding' END AS error FROM p
""")
def landed_pages(spark, d):
    """Pages as bytes under six declared types: what is accepted and what is quarantined, from one pass."""
    kind = F.array(*map(F.lit, _TYPES))[(F.col("page_id") % 6).cast("int")]
    pages = table(spark, d, "pages").select("page_id", F.lit("https://pages.example/x").alias("url"), kind.alias("content_type"), F.encode("html", "UTF-8").alias("payload"))
    accepted, quarantined = landing.snapshots(pages, ["pages.example"])
    columns = ["page_id", "raw_hash"]
    return accepted.select(*columns, F.lit(None).cast("string").alias("error")).unionByName(quarantined.select(*columns, "error"))


@query("""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents)
SELECT count(*) FILTER (doc_id % 3 <> 0) AS selected, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS created,
  count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 = 0) AS stale, 0 AS invalid, count(*) FILTER (doc_id % 3 = 0) AS hits FROM d
""")
def embedding_backfill(spark, d):
    """Documents without a vector of their text get one; those whose text has changed meanwhile don't."""

    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[float(len(t)), float(t.count(" "))] for t in batch])

    rows = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    later = rows.withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit(" changed")))).otherwise(F.col("hash")))
    return landing.backfill(rows, rows.where("doc_id % 3 = 0"), ["doc_id", "hash"], F.col("text"), embed, 2, later)[1]
