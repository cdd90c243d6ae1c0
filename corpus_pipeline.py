"""From raw documents to packed sequences: five stages, each on all that the one before kept.

In each stage a null text counts as empty, a null id is an id like others that comes last, rows that repeat a document
stay or go with it, rows of one id with different texts are judged each by its own, further columns stay whatever their
names, and an empty table gives an empty one. Documents without words are toxic, near copies and contaminated never.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.common import stored
from larkspan.llm.decontaminate import drop_contaminated
from larkspan.llm.exact import drop_copies
from larkspan.llm.jaccard import drop_linked
from larkspan.llm.packing import pack
from larkspan.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject: the score of their whole text is below 0.5."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one with the smallest id; empty ones are equal."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by Jaccard links of 0.8 or more the one with the smallest id, and those without words."""
    return drop_linked(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found at a similarity of 0.8 or more."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, an empty one's end too, and their places in sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("jaccard join", near), ("decontamination", decontamination), ("packing", packing)]

#: Learned scores, edit distances and a tokenizer can't be said in SQL: tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, from the table documents; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
