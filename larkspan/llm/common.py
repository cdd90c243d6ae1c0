"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts of the corpus operators define it.
SPACE = r"[\x20\x09-\x0D]+"
#: Cells of a filter that is broadcast: 2 ** 20 numbers at most, however large the data.
CELLS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a new local one serves a
    local master alone; on a cluster executors wouldn't see each other's files, so that this is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_larkspan_dir", None)
        if folder is None:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            folder = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext._larkspan_dir = folder
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks that ran there, not the steps before. The table goes when
    the driver ends, or before by :func:`forget`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    again = spark.read.schema(schema).parquet(path)
    again._larkspan_path = path
    return again


def forget(df: DataFrame) -> None:
    """Remove the table that ``stored`` wrote for ``df``; nothing that is still to be computed may read it."""
    files, place = _place(df.sparkSession, df._larkspan_path)
    files.delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def version(text: str = "text") -> Column:
    """A hash that tells rows of one id with different texts apart."""
    return F.xxhash64(text_of(text))


def cell(*columns: Column | str) -> Column:
    """One of CELLS cells for a key. A filter by the distinct cells of some keys keeps all rows with these keys and,
    the fuller it is, more or fewer others, so that an exact step must follow."""
    return F.pmod(F.xxhash64(*columns), F.lit(CELLS))


def without(docs: DataFrame, lost: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the rows of which ``lost`` (id, v) has the id and the text's version; null ids are equal."""
    gone = lost.select(F.col("id").alias("lost_id"), F.col("v").alias("lost_v")).distinct()
    same = docs[f"`{doc_id}`"].eqNullSafe(gone["lost_id"]) & (version(text) == gone["lost_v"])
    return docs.join(gone, same, "left_anti")


#: A group of at least one row in so many is large.
LARGE = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has each ``key`` once, with its number of rows as ``size``.

    Groups of a thousandth of all grouped rows, of which there are a thousand at most, are broadcast, and their rows
    dealt by all that they hold, so that no task gets a large group. ``groups`` is read three times."""
    others = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_large = F.col(size) * LARGE >= total
    large = groups.where(is_large).select(key, F.struct(*others).alias("large_group"))
    small = groups.where(~is_large).select(F.col(key).alias("group_key"), F.struct(*others).alias("small_group"))
    dealt = rows.join(F.broadcast(large), key, "left")
    spread = F.when(F.col("large_group").isNull(), F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("n")))
    spread = spread.otherwise(F.struct(F.lit(None).cast(groups.schema[key].dataType).alias("k"), F.xxhash64(*rows.columns).alias("n")))
    own = F.struct(F.col("group_key").alias("k"), F.lit(0).cast("long").alias("n"))
    found = dealt.withColumn("dealt_by", spread).join(small.withColumn("dealt_by", own).drop("group_key"), "dealt_by", "left")
    found = found.withColumn("of_group", F.coalesce("large_group", "small_group"))
    if how != "left":
        found = found.where(F.col("of_group").isNotNull())
    return found.select(*rows.columns, *[F.col("of_group")[c].alias(c) for c in others])


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % parts
