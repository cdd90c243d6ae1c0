"""Tables that a query writes on its way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names. Where it names none, a local folder serves a local
    master alone, as executors elsewhere wouldn't see each other's files. What is there goes when the driver ends."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    path = f"{(folder or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    path, schema = shared_path(df.sparkSession, name), df.schema
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(schema).parquet(path)
