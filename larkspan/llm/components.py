"""Connected components of a graph of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import forget, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label) of all nodes that have a link: the label is the smallest node of the component.

    Each round takes the smallest label among the neighbours, and then the label of that label, until none
    changes; the number of rounds is about the logarithm of the longest path. Labels meet in partial aggregates;
    a node with very many links is a skewed join key, which Spark splits. Self-links and repeated links are
    harmless; a link with a null end is left out; without links there are no rows.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = stored(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "components-links")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "components-labels")
    table = labels
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels.node == seen.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stored(lower.join(jumps, "label").select("node", "old", F.least("label", "next").alias("label")), "components-labels")
        forget(table)
        table, labels = moved, moved.select("node", "label")
        if not moved.where("label < old").limit(1).count():
            return labels
