"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import cell, stored, text_of, version, with_group, without

#: Runs of ASCII white space but single spaces, which stay as they are.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
PREFIX = 96


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_of(text), RUNS, " ")


def hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX, every: bool = False) -> DataFrame:
    """Rows (id, v, h, likely): the SHA-256 of each normalised text whose length and prefix another row has.

    A first scan counts (length, hash of the first ``prefix_chars`` characters), with partial sums in each task:
    a length or prefix that one row alone has goes no further. What is left is broadcast as cells (a fixed number at
    most), by which a second scan chooses the texts that it hashes whole; no text is shuffled. With ``every`` the
    others are hashed in that scan too, as not likely."""
    measure = lambda t: F.struct(F.length(t).alias("n"), F.xxhash64(F.substring(t, 1, prefix_chars)).alias("p"))
    body = docs.select(F.col(f"`{doc_id}`").alias("id"), version(text).alias("v"), normalised(text).alias("t"))
    # the lambda's argument is normalised once, whatever is made of it
    prefixes = body.select(F.transform(F.array("t"), measure)[0].alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    left = prefixes.select(cell("m").alias("left")).distinct()
    measured = body.withColumn("cell", cell(measure(F.col("t"))))
    found = measured.join(F.broadcast(left), F.col("cell") == F.col("left"), "left" if every else "left_semi")
    likely = F.col("left").isNotNull() if every else F.lit(True)
    return stored(found.select("id", "v", F.sha2("t", 256).alias("h"), likely.alias("likely")), "copies-hashes")


def with_groups(hashed: DataFrame) -> DataFrame:
    """``hashed`` with keep_id and group_size, null where no other row has the text; copies meet in partial sums."""
    groups = hashed.where("likely").groupBy("h").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return with_group(hashed, stored(groups.where("group_size > 1"), "copies-groups"), "h", "group_size")


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX) -> DataFrame:
    """Rows (doc_id, text_sha256, keep_id, group_size) of the documents that have a copy.

    The document with the smallest id is the one to keep; a null id comes after all others. Defined cases: a null
    text equals the empty text, and all empty texts form one group; repeated rows of one document count in
    group_size and give one row here; rows of one id with different texts are judged each; other columns are
    ignored; an empty table gives no row.
    """
    found = with_groups(hashes(docs, doc_id, text, prefix_chars)).where("group_size > 1").dropDuplicates(["id", "h"])
    return found.select(F.col("id").alias(doc_id), F.col("h").alias("text_sha256"), "keep_id", "group_size")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents of which an equal one with a smaller id exists; its columns stay as they are.

    Defined cases as for :func:`copy_groups`: a null id goes if its text has another; repeated rows of the document
    that stays stay too; of rows of one id only those go whose own text is a copy."""
    found = with_groups(hashes(docs, doc_id, text)).where("group_size > 1")
    return without(docs, found.where(~F.col("id").eqNullSafe(F.col("keep_id"))), doc_id, text)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_groups(hashes(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=True))
    kept = F.coalesce("keep_id", "id")
    return found.select(
        F.col("id").alias("doc_id"),
        kept.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        kept.eqNullSafe(F.col("id")).alias("kept"),
        F.col("h").alias("text_sha256"),
    )


#: chr(9) to chr(13) and the space, as one class.
OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, min(doc_id) OVER w = doc_id AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
