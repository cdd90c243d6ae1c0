"""Repeated passages: MinHash bands over paragraphs, exact Jaccard among those that collide, components of removals.

A paragraph is a line, or a part of a long one: of the words in each window of WINDOW words one ends a paragraph, the
last of the line or the one with the least hash, at a sentence's end if there is one. So a passage falls into the
same paragraphs wherever it stands in a line, but for what is around its own ends, and none is longer than WINDOW.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import shuffle_partitions, stored, text_of, version, with_group
from larkspan.llm.components import components
from larkspan.llm.jaccard import LEAST
from larkspan.llm.shingles import BLOCK, WORDS, mix, word_hashes

_U = np.uint64
_MUL = _U(0xD6E8FEB86659FD93)
#: Words of which one ends a paragraph.
WINDOW = 16
#: What makes a passage by default: words of repeated paragraphs that follow each other.
LEAST_WORDS = 30
#: Hashes in a band; the number of bands follows from the recall asked for.
BAND_ROWS = 2
RECALL = 0.99
#: Sets with fewer shingles have no similar set but their equals, as one more or less leaves under 0.8.
LEAST_SHINGLES = 4
#: Bits of a shingle's hash beside its paragraph's number in a block, and of the filter by which colliding sets are fetched.
_TOKEN = 44
FILTER = 1 << 23


def bands_for(similarity: float = LEAST / 100, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """The least number of bands that finds pairs of this similarity with this probability."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def _last_of_least(values: np.ndarray, window: int) -> np.ndarray:
    """Where the least value of each window is; of equal ones the last."""
    place, span = np.arange(len(values)), 1
    while span < window:
        gap = min(span, window - span)
        later = values[gap:] <= values[:-gap]
        values, place = np.where(later, values[gap:], values[:-gap]), np.where(later, place[gap:], place[:-gap])
        span += gap
    return place


class Paragraphs:
    """The paragraphs of a block of texts, as arrays: ``text`` (its number), ``number`` in the text, ``start`` and
    ``length`` in characters, ``words``, ``sig`` (equal sets share it) and ``size``; ``tokens`` has the sets' sorted
    shingles one after another, each set's from ``first`` on."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        words, owner, begins, ends = word_hashes(raw)
        joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        lines = np.concatenate([[0], np.cumsum(joined == 10)])
        last = np.ones(len(words), bool)
        last[:-1] = (lines[begins[1:]] > lines[ends[:-1]]) | (owner[1:] != owner[:-1])
        sentence = np.isin(joined[ends - 1], np.frombuffer(b".!?", np.uint8))
        value = mix(words ^ np.append(words[1:], _U(0))[: len(words)] * _MUL) >> _U(1)
        value = np.where(last, _U(0), np.where(sentence, value >> _U(2), value + (_U(1) << _U(62))))
        cut = last.copy()
        if len(words) > WINDOW:
            cut[_last_of_least(value, WINDOW)] = True
        stop = np.flatnonzero(cut) + 1
        begin = np.concatenate([[0], stop[:-1]])[: len(stop)]
        self.text, self.words = owner[begin], stop - begin
        texts_first = np.searchsorted(self.text, np.arange(len(texts)))
        self.number = np.arange(len(stop)) - texts_first[self.text]
        chars = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
        of_text = chars[np.cumsum([0] + [len(r) + 1 for r in raw])]
        self.start = chars[begins[begin]] - of_text[self.text]
        self.length = chars[ends[stop - 1]] - of_text[self.text] - self.start
        self._shingle(words, begin)

    def _shingle(self, words: np.ndarray, begin: np.ndarray) -> None:
        n = max(len(words) - WORDS + 1, 0)
        grams = np.zeros(n, _U)
        for k in range(WORDS):
            grams = grams * _MUL + words[k : n + k]
        times = np.maximum(self.words - WORDS + 1, 1)
        unit = np.repeat(np.arange(len(begin)), times)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(times) - times, times) + begin[unit]
        # of fewer than five words the whole sequence is the only shingle
        inside = np.repeat(np.arange(len(begin)), self.words)
        spelt = mix(words * _MUL + (np.arange(len(words)) - begin[inside] + 7).astype(_U))
        whole = np.add.reduceat(spelt, begin) if len(begin) else spelt
        short = self.words[unit] < WORDS
        value = np.where(short, whole[unit], mix(grams[np.minimum(place, n - 1)]) if n else _U(0))
        keys = np.unique((unit.astype(_U) << _U(_TOKEN)) | (value >> _U(64 - _TOKEN)))
        unit, self.tokens = (keys >> _U(_TOKEN)).astype(np.int64), keys & _U((1 << _TOKEN) - 1)
        self.first = np.searchsorted(unit, np.arange(len(begin)))
        self.size = np.diff(np.append(self.first, len(unit)))
        self.sig = (np.add.reduceat(mix(self.tokens ^ _MUL), self.first) if len(begin) else np.zeros(0, _U)).astype(np.int64)

    def only(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the chosen paragraphs, and where each begins in them."""
        size = self.size[chosen]
        first = np.cumsum(size) - size
        return self.tokens[np.arange(size.sum()) - np.repeat(first - self.first[chosen], size)], first


def least_hashes(tokens: np.ndarray, first: np.ndarray, number: int) -> np.ndarray:
    """The MinHash value ``number`` of each set."""
    return np.minimum.reduceat(mix(tokens ^ mix(np.array([number + 1], _U))), first)


def _blocks(batch: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """From where to where texts of about BLOCK characters reach."""
    a, size = 0, 0
    for b, length in enumerate(batch["text"].map(len), 1):
        size += length
        if size >= BLOCK or b == len(batch):
            yield a, b
            a, size = b, 0


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a, b in _blocks(batch):
            found = Paragraphs(list(batch["text"].iloc[a:b]))
            bounds = np.searchsorted(found.text, np.arange(b - a + 1))
            split = lambda x: [x[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
            out = batch.iloc[a:b][["id", "v"]].reset_index(drop=True)
            out["sigs"], out["words"] = split(found.sig), split(found.words.astype(np.int32))
            out["places"] = split(found.start.astype(np.int64) << 32 | found.length)
            yield out


def _send_bands(n: int, rows: int, bands: int):
    """The (band key, sig) of a block's distinct paragraphs, a parcel for each bucket of keys."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _blocks(batch):
                found = Paragraphs(list(batch["text"].iloc[a:b]))
                chosen = np.unique(found.sig, return_index=True)[1]
                chosen = chosen[found.size[chosen] >= LEAST_SHINGLES]
                if not len(chosen):
                    continue
                tokens, first = found.only(chosen)
                keys = np.zeros((bands, len(chosen)), _U)
                for k in range(rows * bands):
                    keys[k // rows] = mix(keys[k // rows] * _U(31) + least_hashes(tokens, first, k) + _U(k))
                keys, sigs = keys.ravel(), np.tile(found.sig[chosen], bands)
                bucket = (keys % _U(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, sigs, bounds = keys[order], sigs[order], np.searchsorted(bucket[order], np.arange(n + 1))
                yield pd.DataFrame([(k, keys[i:j].tobytes(), sigs[i:j].tobytes()) for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if j > i], columns=["bucket", "keys", "sigs"])

    return send


def _collide(group: pd.DataFrame) -> pd.DataFrame:
    """The distinct sigs at keys that have more than one."""
    keys, sigs = (np.frombuffer(b"".join(group[c]), "<i8") for c in ("keys", "sigs"))
    order = np.lexsort((sigs, keys))
    keys, sigs = keys[order], sigs[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sigs[1:] != sigs[:-1])])[: len(keys)]
    keys, sigs = keys[fresh], sigs[fresh]
    again = keys[1:] == keys[:-1]
    keep = (np.concatenate([again, [False]]) | np.concatenate([[False], again]))[: len(keys)]
    return pd.DataFrame({"sig": np.unique(sigs[keep])})


def filter_of(sigs: DataFrame) -> np.ndarray:
    """Which of FILTER cells have a sig: a bitmap of a fixed size, made by Spark in parts."""
    cells = sigs.select((F.pmod("sig", F.lit(FILTER)) + 1).alias("cell"))
    parts = cells.groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    out = np.zeros((FILTER // 8 // 4096, 4096), np.uint8)
    for r in parts:
        out[r["part"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _fetch(wanted):
    """(sig, tokens) of a block's distinct paragraphs in the filter."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = wanted.value
        for batch in batches:
            for a, b in _blocks(batch):
                found = Paragraphs(list(batch["text"].iloc[a:b]))
                chosen = np.unique(found.sig, return_index=True)[1]
                cell = np.mod(found.sig[chosen], FILTER)
                chosen = chosen[(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0) & (found.size[chosen] >= LEAST_SHINGLES)]
                tokens, first = found.only(chosen)
                yield pd.DataFrame({"sig": found.sig[chosen], "tokens": [t.astype("<u8").tobytes() for t in np.split(tokens, first[1:])] if len(chosen) else []})

    return fetch


def _subsets(held):
    """(key, sig, sibling): the signatures of what is left of each set without one or two of its shingles, where a set
    of that signature would be similar. All sets with a key that says ``sibling`` are similar to each other; the other
    keys count only where there is a set that has the key as its own signature, and come if it may be in the filter."""

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for batch in batches:
            names, size = batch["sig"].to_numpy(np.int64), batch["tokens"].map(len).to_numpy(np.int64) // 8
            for n in np.unique(size):
                of_size = size == n
                sigs = names[of_size]
                parts = mix(np.frombuffer(b"".join(batch["tokens"][of_size]), "<u8").reshape(-1, n) ^ _MUL)
                without = [parts] if similar(n - 1, n) else []
                if similar(n - 2, n):
                    i, j = np.triu_indices(n, 1)
                    without.append(parts[:, i] + parts[:, j])
                for k, out in enumerate(without):
                    keys, sibling = (sigs.astype(_U)[:, None] - out).astype(np.int64).ravel(), k == 0 and similar(n - 1, n + 1)
                    owner = np.repeat(sigs, out.shape[1])
                    if not sibling:
                        cell = np.mod(keys, FILTER)
                        chosen = bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0
                        keys, owner = keys[chosen], owner[chosen]
                    yield pd.DataFrame({"key": keys, "sig": owner, "sibling": sibling})

    return subsets


def similar(common: int, union: int) -> bool:
    return 100 * common >= LEAST * union


def similar_paragraphs(sets: DataFrame) -> DataFrame:
    """Rows (a, b): links between the sets (sig, tokens), so that their components are those of all similar pairs.

    A set has WINDOW - WORDS + 1 shingles at most, so that of two similar ones either has at most one shingle that the
    other lacks, or one has two more and the other none. So they share what is left of them without these, and a
    signature is a sum, from which shingles can be taken. A set is linked to each similar set within it; of sets that
    are the same but for one shingle, each is linked to the first. That is exact, and no set has more than 78 keys."""
    held = sets.sparkSession.sparkContext.broadcast(filter_of(sets))
    keyed = stored(sets.mapInPandas(_subsets(held), "key long, sig long, sibling boolean"), "paragraphs-subsets")
    within = keyed.join(sets.select(F.col("sig").alias("key")), "key", "left_semi").select(F.col("key").alias("a"), F.col("sig").alias("b"))
    siblings = keyed.where("sibling")
    first = siblings.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("last")).where("a < last").drop("last")
    beside = siblings.join(first, "key").where("a <> sig").select("a", F.col("sig").alias("b"))
    return stored(within.unionByName(beside).distinct(), "paragraphs-links")


def _among(wanted):
    """Of each document's paragraphs those in the filter."""

    def among(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = wanted.value
        for batch in batches:
            sigs = [np.asarray(s, np.int64) for s in batch["sigs"]]
            some = [np.flatnonzero(bits[c >> 3] >> (c & 7).astype(np.uint8) & 1) for c in (np.mod(s, FILTER) for s in sigs)]
            out = batch[["id", "v"]].copy()
            out["paragraphs"] = [k.astype(np.int32) for k in some]
            for column in ("sigs", "words", "places"):
                out[column] = [np.asarray(x)[k] for x, k in zip(batch[column], some)]
            yield out[[len(k) > 0 for k in some]]

    return among


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = BAND_ROWS, recall: float = RECALL, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc_id, paragraph, start, length, words, passage_words, cluster_id, cluster_size, keep_doc_id, keep_paragraph,
    removed).

    Paragraphs that are equal or similar (Jaccard similarity of five-word shingles at least 0.8, found by bands with
    the probability ``recall``), directly or by way of others, are a cluster, and repeated if it has more than one
    document's; the first by document and place stays, the others are removed. There is a row for each repeated paragraph
    in a run of repeated ones with ``least_words`` words or more together (passage_words); with 0, as op10 has it, for
    each repeated paragraph, down to a line of one word. start and length are in characters.

    Defined cases: a null text counts as empty and has no paragraphs; a paragraph of fewer than five words has the
    whole sequence as its only shingle; paragraphs with equal sets are one node, however many they are; a row that
    repeats a document's id and text is that document, and rows of one id with different texts are documents of their
    own; null ids come after all others; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    bands = bands_for(LEAST / 100, rows, recall)
    body = docs.select(F.col(f"`{doc_id}`").alias("id"), version(text).alias("v"), text_of(text).alias("text"))
    kind = body.schema["id"].dataType.simpleString()
    each = stored(body.mapInPandas(_units, f"id {kind}, v long, sigs array<long>, words array<int>, places array<long>"), "paragraphs")
    document = F.hash("id", "v")
    ends = F.min(document).alias("low"), F.max(document).alias("high")
    names = each.select("id", "v", F.explode("sigs").alias("sig")).groupBy("sig").agg(*ends, F.count(F.lit(1)).alias("times"))
    equal = stored(names.where("low < high").select("sig", "times"), "paragraphs-equal")

    total = each.agg(F.sum(F.size("sigs"))).first()[0] or 0
    n = max(shuffle_partitions(spark), total * bands // 2_000_000)
    parcels = body.mapInPandas(_send_bands(n, rows, bands), "bucket int, keys binary, sigs binary")
    wanted = stored(parcels.groupBy("bucket").applyInPandas(_collide, "sig long").distinct(), "paragraphs-collided")
    sent = spark.sparkContext.broadcast(filter_of(wanted))
    fetched = body.mapInPandas(_fetch(sent), "sig long, tokens binary").dropDuplicates(["sig"])
    sets = stored(fetched.join(wanted, "sig", "left_semi"), "paragraphs-sets")
    similar = components(similar_paragraphs(sets)).withColumnRenamed("node", "sig")

    # the number of rows of a set is only known where it is above one
    known = stored(
        equal.join(similar, "sig", "full").select("sig", F.coalesce("label", "sig").alias("label"), F.coalesce("times", F.lit(1).cast("long")).alias("times")), "paragraphs-known"
    )
    likely = spark.sparkContext.broadcast(filter_of(known.select("sig")))
    some = each.mapInPandas(_among(likely), f"id {kind}, v long, paragraphs array<int>, sigs array<long>, words array<int>, places array<long>")
    units = some.select("id", "v", F.explode(F.arrays_zip("paragraphs", "sigs", "words", "places")).alias("p"))
    units = units.select("id", "v", F.col("p.paragraphs").alias("paragraph"), F.col("p.sigs").alias("sig"), F.col("p.words").alias("words"), F.col("p.places").alias("place"))
    repeated = with_group(units, known, "sig", "times", "inner").repartition("id", "v").dropDuplicates(["id", "v", "paragraph"])
    repeated = stored(repeated, "paragraphs-repeated")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "v", "paragraph")
    clusters = repeated.groupBy("label").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("cluster_size"), *ends)
    clusters = stored(clusters.where("low < high").drop("low", "high"), "paragraphs-clusters")
    marked = with_group(repeated, clusters, "label", "cluster_size", "inner")
    by_doc = Window.partitionBy("id", "v").orderBy("paragraph")
    runs = marked.withColumn("run", F.col("paragraph") - F.row_number().over(by_doc))
    long = runs.withColumn("passage_words", F.sum("words").over(Window.partitionBy("id", "v", "run"))).where(F.col("passage_words") >= least_words)
    first = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("v") == F.col("keep.v")) & (F.col("paragraph") == F.col("keep.paragraph"))
    return long.select(
        F.col("id").alias(doc_id), "paragraph", F.shiftright("place", 32).cast("int").alias("start"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("length"), "words", "passage_words",
        F.col("label").alias("cluster_id"), "cluster_size", F.col("keep.id").alias(f"keep_{doc_id}"), F.col("keep.paragraph").alias("keep_paragraph"), (~first).alias("removed"),
    )


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated paragraph; who wants passages alone filters by passage_words."""
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_words=0)
