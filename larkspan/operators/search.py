"""Lists, keyword search and exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.text import contains_text


def keyword_search(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | contains_text(F.col(c), term)
    return rows.where(found)


def visible(rows: DataFrame, owners: DataFrame, key: str, approved) -> DataFrame:
    """Rows whose owner is approved; the one predicate that all reads share."""
    return rows.join(owners.where(approved).select(key), key, "left_semi")


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, top: int, block: int = 4096) -> DataFrame:
    """(query_id, key, relevance, position): for each query the ``top`` rows by cosine to six digits, ties by key.

    ``queries`` has (query_id, query). They go over the rows in blocks of at most ``block``; a task multiplies each
    batch of rows with the block and keeps the best of the batch, so that few rows are shuffled. Zero vectors have
    no relevance and are left out."""
    kinds = dict(vectors.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {kinds[key]}, relevance double"
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // (block // 2))))))
    found = None
    for k in sorted(r["_block"] for r in numbered.select("_block").distinct().collect()):
        rows = numbered.where(F.col("_block") == k).select("query_id", "query").toPandas()  # at most a block
        sent = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), np.stack([np.asarray(q, float) for q in rows["query"]])))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, asked = sent.value
            asked_norm = np.linalg.norm(asked, axis=1)
            for batch in batches:
                batch = batch.sort_values(key, kind="stable")
                matrix = np.stack([np.asarray(v, float) for v in batch[vector]]) if len(batch) else np.zeros((0, asked.shape[1]))
                norm = np.linalg.norm(matrix, axis=1)[:, None] * asked_norm[None, :]
                cosine = np.round(np.clip(np.divide(matrix @ asked.T, norm, out=np.full(norm.shape, -9.0), where=norm > 0), -9, 1), 6)
                order = np.argsort(-cosine, axis=0, kind="stable")[:top]
                keys = batch[key].to_numpy()
                out = pd.DataFrame({"query_id": np.tile(ids, len(order)), key: keys[order].ravel(), "relevance": np.take_along_axis(cosine, order, 0).ravel()})
                yield out[out["relevance"] > -9]

        part = vectors.select(key, vector).mapInPandas(best, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), key))
    return found.withColumn("position", rank).where(F.col("position") <= top)
