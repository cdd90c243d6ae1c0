"""Reading of the named parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``; any path that Spark's readers open."""
    return spark.read.parquet(f"{root}/{name}.parquet")
