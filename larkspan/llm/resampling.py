"""Importance resampling towards a target distribution of hashed n-grams, whose CRCs come from running prefix CRCs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import shuffle_partitions, stored, text_of

BUCKETS = 10_000
GRAMS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Ranges of scores that are counted before the highest ones are sorted.
STEPS = 1000
#: Bytes of text scanned at a time.
BLOCK = 1 << 20

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Lengths below this are shifted in one step.
SHORT = 128

#: A-Z to lower case, what separates words to a space; digits, letters and bytes beyond ASCII stay.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    """What one byte of zeros makes of each register value's last byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values for each of the four bytes."""
    out = tables[0][values & 0xFF] ^ tables[1][(values >> 8) & 0xFF]
    return out ^ tables[2][(values >> 16) & 0xFF] ^ tables[3][values >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps that append zero bytes: for each number below SHORT, and for each power of two."""
    identity = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [identity]
    for _ in range(SHORT - 1):
        short.append((short[-1] >> np.uint32(8)) ^ _BYTE[short[-1] & 0xFF])
    powers = [short[1]]
    for _ in range(31):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


_SHORT, _POWERS = _shift_tables()
_FLAT = np.ascontiguousarray(_SHORT.reshape(SHORT, 4 * 256)).reshape(-1)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC's part in the CRC of its bytes with so many others appended: a multiplication in GF(2)[x]."""
    base = np.minimum(lengths, SHORT - 1).astype(np.int64) * 1024
    out = _FLAT[base + (crcs & 0xFF)] ^ _FLAT[base + 256 + ((crcs >> 8) & 0xFF)]
    out ^= _FLAT[base + 512 + ((crcs >> 16) & 0xFF)]
    out ^= _FLAT[base + 768 + (crcs >> 24)]
    rest = np.maximum(lengths - (SHORT - 1), 0)
    for k in range(int(rest.max(initial=0)).bit_length()):
        at = np.flatnonzero((rest >> k) & 1)
        out[at] = _apply(_POWERS[k], out[at])
    return out


def _spaced(crcs: np.ndarray) -> np.ndarray:
    """The CRCs after one more space."""
    inner = ~crcs
    return ~((inner >> np.uint32(8)) ^ _BYTE[(inner ^ np.uint32(32)) & np.uint32(0xFF)])


def text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def gram_crcs(words: list[bytes]) -> list[np.ndarray]:
    """For n = 1, 2, 3 the CRCs of all runs of n words joined by a space, in order.

    The normalised text, each word after a space, is scanned once; its running CRC is kept at each word's end. The
    prefix before a run, shifted by the run's length, cancels out of the prefix that ends with it."""
    if not words:
        return [np.zeros(0, np.uint32)] * GRAMS
    # the CRC goes on from word to word; a space comes before each word
    ends = np.fromiter(accumulate(words, lambda c, w: zlib.crc32(w, zlib.crc32(b" ", c)), initial=0), np.uint32, len(words) + 1)
    begins = _spaced(ends[:-1])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1)
    out = []
    for n in range(1, GRAMS + 1):
        count = max(len(words) - n + 1, 0)
        spans = stops[n - 1 :][:count] - (stops[:count] - lengths[:count])
        out.append(ends[n:][:count] ^ shifted(begins[:count], spans))
    return out


def _blocks(texts: pd.Series) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Blocks of texts: the buckets of their runs of n words, the text of each run, and the words of each text."""

    def made(words: list[bytes], counts: list[int]):
        owner = np.repeat(np.arange(len(counts)), counts)
        buckets, owners = [], []
        for n, crcs in enumerate(gram_crcs(words)):
            inside = owner[: len(crcs)] == owner[n : n + len(crcs)]  # no run crosses the end of a text
            buckets.append((crcs[inside] % np.uint32(BUCKETS)).astype(np.int64))
            owners.append(owner[: len(crcs)][inside])
        return buckets, owners, np.array(counts, np.int64)

    words: list[bytes] = []
    counts: list[int] = []
    size = 0
    for text in texts:
        own = text_words(text)
        words += own
        counts.append(len(own))
        size += len(text)
        if size >= BLOCK:
            yield made(words, counts)
            words, counts, size = [], [], 0
    if counts:
        yield made(words, counts)


def feature_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (bucket, features): how many features of all texts fall into each bucket that has any; a task sends one
    number a bucket. An empty table, or texts without words, give no row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets, _, _ in _blocks(batch["t"]):
                for b in buckets:
                    total += np.bincount(b, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "features": total[found]})

    return docs.select(text_of(text).alias("t")).mapInPandas(count, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text") -> np.ndarray:
    """The gain of each bucket, as BUCKETS integers: a thousand times the log ratio of the smoothed shares of the
    bucket among the target's features and among those of ``docs``, rounded down."""
    spark = docs.sparkSession
    every = spark.range(BUCKETS).withColumnRenamed("id", "bucket")
    ours = feature_counts(docs, text).withColumnRenamed("features", "s")
    theirs = feature_counts(target, text).withColumnRenamed("features", "t")
    # BUCKETS rows, however large the tables
    rows = every.join(ours, "bucket", "left").join(theirs, "bucket", "left").fillna(0, ["s", "t"])
    rows = rows.select("bucket", *[F.col(c).cast("double").alias(c) for c in ("s", "t")])
    totals = F.sum("s").over(Window.partitionBy()).alias("all_s"), F.sum("t").over(Window.partitionBy()).alias("all_t")
    ratio = ((F.col("t") + 1) * (F.col("all_s") + BUCKETS)) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    gains = rows.select("bucket", "s", "t", *totals).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return np.array([r["gain"] for r in sorted(gains)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): the sum of the gains of all features of each text."""

    @F.pandas_udf("n_words long, weight long")
    def weights(texts: pd.Series) -> pd.DataFrame:
        out = []
        for buckets, owners, counts in _blocks(texts):
            weight = np.zeros(len(counts), np.int64)
            for b, o in zip(buckets, owners):
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gains[b])])
                edges = np.searchsorted(o, np.arange(len(counts) + 1))
                weight += sums[edges[1:]] - sums[edges[:-1]]
            out.append(pd.DataFrame({"n_words": counts, "weight": weight}))
        return pd.concat(out) if out else pd.DataFrame({"n_words": [], "weight": []}, dtype="int64")

    n = F.col("w.n_words")
    features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, GRAMS)), n)
    found = docs.select(F.col(f"`{doc_id}`").alias(doc_id), weights(text_of(text)).alias("w"))
    return found.select(doc_id, n.alias("n_words"), features.alias("n_features"), F.col("w.weight").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold draw from the Gumbel distribution, rounded down, that the seed and the id fix; a null id is 'null'."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: Column, doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``scored`` with a rank 1, 2, 3... for the floor of ``percent`` per cent of the eligible rows with the highest
    scores, ties to the smaller id; null for all others.

    Approximate quantiles cut the scores into ranges, whose exact counts tell which ranges are drawn; only these rows
    are sorted, dealt out by score and id so that equal scores spread too. A rank is a row's place in its task plus the
    counts of the tasks before, so that no task sorts all. ``scored`` is read three times and should be a table."""
    parts = shuffle_partitions(scored.sparkSession)
    marked = scored.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    shares = f"array({', '.join(repr(i / STEPS) for i in range(1, STEPS))})"
    found = marked.where("eligible").agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(score, {shares}, {20 * STEPS})").alias("cuts")).first()
    wanted = percent * found["n"] // 100
    if not wanted:
        return marked.drop("eligible").withColumn("rank", F.lit(None).cast("long"))
    cuts = sorted(set(found["cuts"]))
    passed = F.size(F.filter(F.expr(f"array({', '.join(f'{c}L' for c in cuts)})"), lambda c: c <= F.col("score")))
    counts = {r["passed"]: r["n"] for r in marked.where("eligible").groupBy(passed.alias("passed")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # the highest cut that enough rows reach bounds what is sorted
    reaching = list(accumulate(counts.get(k, 0) for k in range(len(cuts), 0, -1)))[::-1]
    least = max((c for c, n in zip(cuts, reaching) if n >= wanted), default=None)
    drawn = F.col("eligible") if least is None else F.col("eligible") & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last(doc_id)]
    dealt = stored(marked.where(drawn).repartitionByRange(parts, *order).withColumn("dealt_to", F.spark_partition_id()), "resampling-drawn")
    counts = sorted((r["dealt_to"], r["n"]) for r in dealt.groupBy("dealt_to").agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip([p for p, _ in counts], accumulate([0] + [n for _, n in counts])))
    offsets = F.expr("map(" + ", ".join(f"{p}, {n}L" for p, n in before.items()) + ")")
    place = F.row_number().over(Window.partitionBy("dealt_to").orderBy(*order)) + offsets[F.col("dealt_to")]
    top = dealt.withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = marked.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    columns = [*scored.columns, "rank"]
    return top.select(*columns).unionByName(rest.select(*columns))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank) of all documents; the drawn ones have a rank.

    The score is the weight plus Gumbel noise that the id and seed fix, so that the highest scores are a draw without
    replacement in proportion to the exponential of the weights. Counts cover all texts of both tables.

    Defined cases: a null text has no words; documents of fewer than 20 words get weight and score, but are never
    drawn; equal texts have equal weights; repeated rows count each and get a rank each; a null id is drawn as the name
    'null' and comes last among equal scores; other columns are ignored; an empty target has equal shares in all
    buckets; an empty table gives no row."""
    gains = bucket_gains(docs, target, text)
    scored = weigh(docs, gains, doc_id, text).withColumn("score", F.col("weight") + noise(F.col(f"`{doc_id}`"), seed))
    return ranked(stored(scored, "resampling-scored"), F.col("n_words") >= LEAST_WORDS, doc_id, percent)


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The documents drawn, with their columns as they are; rows of one id are drawn together if one of them is."""
    found = resample(docs, target, doc_id, text, percent, seed).where("rank IS NOT NULL").select(F.col(doc_id).alias("drawn_id")).distinct()
    return docs.join(found, docs[f"`{doc_id}`"].eqNullSafe(found["drawn_id"]), "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRCs of the distinct features, eight bytes a step; the table of a byte's effect comes from the polynomial.
OP12_SQL = rf"""
WITH RECURSIVE poly AS (
  SELECT b, 0 AS k, b AS c FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END FROM poly WHERE k < 8
), tab AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM poly WHERE k = 8
), texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT kind, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (
    SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts)
), g AS (
  SELECT kind, id, w1, w1 || ' ' || lead(w1) OVER o AS w2, w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY kind, id ORDER BY i)
), f AS MATERIALIZED (
  SELECT kind, id, unnest([w1, w2, w3]) AS f FROM g
), u AS MATERIALIZED (
  SELECT row_number() OVER () AS u, f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f WHERE f IS NOT NULL)
), crc AS (
  SELECT u, x, 1 AS k, 4294967295::BIGINT AS c FROM u
  UNION ALL
  SELECT u, x, k + 2, xor(c >> 8, t[(xor(c, ('0x' || substring(x, k, 2))::BIGINT) & 255) + 1]) FROM crc, tab WHERE k < length(x)
), bucket AS MATERIALIZED (
  SELECT u.f, xor(c, 4294967295) % {BUCKETS} AS b FROM crc JOIN u USING (u) WHERE k = length(crc.x) + 1
), h AS MATERIALIZED (
  SELECT kind, id, b FROM f JOIN bucket USING (f)
), n AS (
  SELECT r.b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM range({BUCKETS}) r(b) LEFT JOIN h USING (b) GROUP BY r.b
), gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM n
), weight AS (
  SELECT id AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM h JOIN gain USING (b) WHERE kind = 0 GROUP BY id
), words AS (
  SELECT id AS doc_id, count(*) AS n_words FROM w WHERE kind = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weight USING (doc_id) LEFT JOIN words USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
