"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import shuffle_partitions, text_of

WORDS = 5
#: Share of all hashes that a sketch keeps: those below this bound, an eighth of them by default.
FRACTION = 1 / 8
#: A sketch with fewer hashes below the bound keeps its so many smallest ones.
LEAST = 32
#: Hex digits of a hash, and the greatest one.
DIGITS = 16
_ALL = "f" * DIGITS


def bound(fraction: float = FRACTION) -> str:
    """The smallest hash that isn't below ``fraction``, as hex digits, in whose order the hashes are compared."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    return f"{int(fraction * 16**DIGITS):0{DIGITS}x}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, lower-cased; ASCII white space separates them."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """The first 64 bits of the MD5 of each five-word shingle in order, repeats included; of the whole sequence of
    words where there are fewer; no hash where there are no words."""

    def of(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - WORDS, F.lit(0)))
        # concat_ws skips what lies past the end of a short text
        hashed = F.transform(starts, lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(ws, i + k) for k in range(WORDS)])), 1, DIGITS))
        return F.when(F.size(ws) > 0, hashed).otherwise(F.array().cast("array<string>"))

    return _let(words(text), of)


def _kept(hashes: Column, fraction: float, least: int) -> Column:
    below = F.array_distinct(F.filter(hashes, lambda h: h < bound(fraction)))
    return _let(below, lambda b: F.when(F.size(b) >= least, F.array_sort(b)).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, least)))


def sketch(text: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of a text: the distinct shingle hashes below ``fraction`` in order, or the ``least`` smallest ones
    where fewer lie below it, so that short texts have sketches too. A null text counts as empty; empty texts have
    empty sketches."""
    return _let(shingle_hashes(F.coalesce(text, F.lit(""))), lambda hashes: _kept(hashes, fraction, least))


def limit(s: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The hash up to which a sketch holds all hashes of its text: all there are where it holds fewer than ``least``."""
    below = f"{int(bound(fraction), 16) - 1:0{DIGITS}x}"
    return F.when(F.size(s) < least, F.lit(_ALL)).otherwise(F.greatest(F.element_at(s, -1), F.lit(below)))


def merge(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of the union of two texts' shingles, from their sketches alone: equal to the sketch made of both."""
    return _kept(F.array_union(a, b), fraction, least)


def estimates(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """A struct (likeness, held) of two sketches: the estimated Jaccard similarity of their texts' shingle sets, and
    the estimated share of the first one's shingles that the second one has.

    Both are judged on the hashes up to the smaller of the two reaches, where both sketches are whole; sets of fewer
    than ``least`` shingles are compared exactly. Two empty sketches are alike, one empty one is like no other."""

    def of(reach: Column) -> Column:
        own, other = F.filter(a, lambda h: h <= reach), F.filter(b, lambda h: h <= reach)
        return _let(
            F.struct(F.size(F.array_intersect(own, other)).alias("both"), F.size(own).alias("own"), F.size(other).alias("other")),
            lambda n: F.struct(
                F.when(n["own"] + n["other"] == 0, 1.0).otherwise(n["both"] / (n["own"] + n["other"] - n["both"])).alias("likeness"),
                F.when(n["own"] + n["other"] == 0, 1.0).when(n["own"] == 0, 0.0).otherwise(n["both"] / n["own"]).alias("held"),
            ),
        )

    return _let(F.least(limit(a, fraction, least), limit(b, fraction, least)), of)


def fingerprint(s: Column) -> Column:
    """A sketch as text: its hashes in order, 16 hex digits each; empty for a text without words."""
    return F.array_join(s, "")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, sketch) of all documents, in one pass without a shuffle.

    Defined cases: a null text counts as empty, whose sketch is empty; very long texts grow a sketch in proportion;
    equal texts have equal sketches; repeated rows and rows of one or no id give a row each; other columns are
    ignored; an empty table gives no row."""
    return docs.select(F.col(f"`{doc_id}`").alias(doc_id), sketch(text_of(text), fraction, least).alias("sketch"))


def group_sketches(sketches: DataFrame, key: str, fraction: float = FRACTION) -> DataFrame:
    """Rows (key, h): the hashes below ``fraction`` of all texts of a key, which form the key's merged sketch.

    A merged sketch of very many texts is a set of rows, dealt by hash, so that no task holds a large key's sketch.
    A key with no hash below the bound has no row; null keys are one key."""
    return sketches.select(F.col(f"`{key}`").alias(key), F.explode("sketch").alias("h")).where(F.col("h") < bound(fraction)).distinct()


def contained(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """Rows (key, other, hashes, both, held): for each key of ``small`` with a shared hash and each key of ``large``, the
    share of the first one's hashes that the other has. Both are results of :func:`group_sketches`."""
    own = small.select(F.col(f"`{key}`").alias("own"), "h")
    sizes = own.groupBy("own").agg(F.count(F.lit(1)).alias("hashes"))
    both = own.join(large.select(F.col(f"`{key}`").alias("other"), "h"), "h").groupBy("own", "other").agg(F.count(F.lit(1)).alias("both"))
    return both.join(sizes, both["own"].eqNullSafe(sizes["own"])).select(
        both["own"].alias(key), "other", "hashes", "both", (F.col("both") / F.col("hashes")).alias("held")
    )


def _bounds(docs: DataFrame, doc_id: str, parts: int) -> list[int]:
    """Ids of the table, in order, that cut it into about ``parts`` equal ranges; the last one is the largest id."""
    shares = f"array({', '.join(repr(i / parts) for i in range(1, parts + 1))})"
    found = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id")).agg(
        F.expr(f"percentile_approx(id, {shares}, {max(10_000, 20 * parts)})").alias("cuts"), F.max("id").alias("last")
    ).first()
    return sorted({*(found["cuts"] or []), *([] if found["last"] is None else [found["last"]])})


def _numbers(ns: list[int]) -> str:
    return f"array({', '.join(f'{n}L' if n > -(1 << 63) else 'CAST(-9223372036854775808 AS BIGINT)' for n in ns)})"


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the bounds are less than the value, looked up in two steps of about the square root of their number;
    0 for null. Values are at most the last bound."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5)
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lasts, every = F.expr(_numbers([r[-1] for r in runs])), F.expr(f"array({', '.join(map(_numbers, runs))})")
    below = lambda bs, v: F.size(F.filter(bs, lambda b: b < v))
    return _let(value, lambda v: _let(below(lasts, v), lambda run: run * step + below(F.get(every, run), v)))


def with_next(rows: DataFrame, doc_id: str, add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` with a struct ``next`` of all columns of the next row by descending id; after the last comes the first.

    Rows are dealt by ranges of ids, of about equally many rows; a range's first row is also sent to the range before
    it, whose last row it follows, so that one shuffle is all. ``add`` adds columns after it, once a row. Ids are
    cast to integers; null ids come last, and rows that share an id go by their columns, descending."""
    bounds = _bounds(rows, doc_id, shuffle_partitions(rows.sparkSession))
    value, ranges = F.col(f"`{doc_id}`").cast("long"), max(len(bounds), 1)
    own = _range_of(value, bounds)
    leads = F.get(F.expr(_numbers(bounds)), F.col("own_range")) == value if bounds else F.lit(True)
    at = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    here = at(F.col("own_range"), 0)
    seats = F.when(leads, F.array(here, at((F.col("own_range") + 1) % ranges, 1))).otherwise(F.array(here))
    seated = rows.withColumn("own_range", own).withColumn("seat", F.explode(seats)).repartitionById(ranges, F.col("seat.range"))
    whole = add(seated)
    names = [c for c in whole.columns if c not in ("own_range", "seat")]
    order = Window.partitionBy("seat.range").orderBy("seat.guest", F.desc_nulls_last(value), *[F.desc(c) for c in rows.columns if c != doc_id])
    ahead = whole.select(*names, "seat", *[F.lead(c).over(order).alias(f"next_{i}") for i, c in enumerate(names)]).where("seat.guest = 0")
    return ahead.select(*names, F.struct(*[F.col(f"next_{i}").alias(c) for i, c in enumerate(names)]).alias("next"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """Rows (id, t, s, edited, next_s): each document's text and sketch, its edited text, and the next one's sketch.

    The edited text has, in place of the last third of the characters, as many of the first ones of the next document
    by descending id. Texts travel in one shuffle, and a sketch is made once, after it. Defined cases as for
    :func:`fingerprints` and :func:`with_next`; a document that is alone is its own next one."""
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), text_of(text).alias("t"))
    paired = with_next(base, "id", lambda df: df.withColumn("s", sketch(F.col("t"), fraction, least)))
    third = F.floor(F.length("t") / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.length("t") - third), F.substring("next.t", F.lit(1), third))
    return paired.select("id", "t", "s", edited.alias("edited"), F.col("next.s").alias("next_s"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("edited_s", sketch(F.col("edited")))
    told = pairs.withColumn("e", estimates(F.col("s"), F.col("edited_s"))).withColumn("n", estimates(F.col("s"), F.col("next_s")))
    return told.select(
        F.col("id").alias("doc_id"),
        F.length("t").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("edited_s")).alias("edited_fingerprint"),
        F.col("e.likeness").alias("near_edited"),
        F.col("n.likeness").alias("near_next"),
        F.col("e.held").alias("held_by_edited"),
        F.col("n.held").alias("held_by_next"),
    )


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), p AS (
  SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t DESC)
), e AS (
  SELECT *, substring(t, 1, length(t) - length(t) // 3) || substring(next_t, 1, length(t) // 3) AS edited FROM p
), texts AS (
  SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), w AS (
  SELECT doc_id, kind, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (SELECT doc_id, kind, list_filter(regexp_split_to_array(lower(t), '[ 	-
]+'), lambda x: x <> '') AS ws FROM texts)
), g AS (
  SELECT doc_id, kind, i, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM w WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)
), h AS (
  SELECT DISTINCT doc_id, kind, substring(md5(shingle), 1, {DIGITS}) AS h FROM g WHERE i <= greatest(n - {WORDS - 1}, 1)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY h) AS rn,
         count(*) FILTER (h < '{bound()}') OVER (PARTITION BY doc_id, kind) AS below FROM h
), s AS (
  SELECT doc_id, kind, list(h ORDER BY h) AS s FROM r
  WHERE CASE WHEN below >= {LEAST} THEN h < '{bound()}' ELSE rn <= {LEAST} END GROUP BY ALL
), k AS (
  SELECT e.doc_id, e.kind, coalesce(s.s, []) AS s,
         CASE WHEN coalesce(len(s.s), 0) < {LEAST} THEN '{_ALL}' ELSE greatest(s.s[-1], '{int(bound(), 16) - 1:0{DIGITS}x}') END AS reach
  FROM texts e LEFT JOIN s USING (doc_id, kind)
), q AS (
  SELECT e.doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256, a.s, b.s AS edited_s, n.s AS next_s,
         least(a.reach, b.reach) AS near_reach, least(a.reach, n.reach) AS next_reach
  FROM e JOIN k a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN k b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN k n ON n.doc_id = e.next_id AND n.kind = 0
), c AS (
  SELECT *, len(list_intersect(s, list_filter(edited_s, lambda x: x <= near_reach))) AS both_e,
         len(list_filter(s, lambda x: x <= near_reach)) AS own_e, len(list_filter(edited_s, lambda x: x <= near_reach)) AS other_e,
         len(list_intersect(s, list_filter(next_s, lambda x: x <= next_reach))) AS both_n,
         len(list_filter(s, lambda x: x <= next_reach)) AS own_n, len(list_filter(next_s, lambda x: x <= next_reach)) AS other_n
  FROM q
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(edited_s, '') AS edited_fingerprint,
       CASE WHEN own_e + other_e = 0 THEN 1.0::DOUBLE ELSE both_e / (own_e + other_e - both_e) END AS near_edited,
       CASE WHEN own_n + other_n = 0 THEN 1.0::DOUBLE ELSE both_n / (own_n + other_n - both_n) END AS near_next,
       CASE WHEN own_e + other_e = 0 THEN 1.0::DOUBLE WHEN own_e = 0 THEN 0.0 ELSE both_e / own_e END AS held_by_edited,
       CASE WHEN own_n + other_n = 0 THEN 1.0::DOUBLE WHEN own_n = 0 THEN 0.0 ELSE both_n / own_n END AS held_by_next
FROM c
"""
