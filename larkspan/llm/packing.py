"""Packing: shortest pack first over the histogram of lengths, then patterns joined back to documents by rank."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import stored, text_of

WINDOW = 1024
END = 0
#: Characters that both tokenizer libraries split alike; a text with others goes to the one that defines the ids.
COMMON = re.compile(r"[\n\r\t\x20-\x7e\xa1-ɏ]*")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from a text to its ids by the vocabulary file at ``path``, which every executor has.

    Where the same vocabulary lies beside it as ranks, texts of common characters take that faster way."""
    import os

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: fast.encode_ordinary(text) if "<|" not in text and COMMON.fullmatch(text) else plain(text)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens): whole windows of each document, and the rest."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), text_of(text).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path)
        for batch in batches:
            out = []
            for key, body in zip(batch["id"], batch["text"]):
                ids = np.array([*encode(body), END], dtype="<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    out.append((key, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[int]]]:
    """(count, lengths) of packs, from the count of each length.

    Lengths are placed longest first, each into the packs it fills, else into the pack with the least content
    that takes it, else into new ones; a pattern's count is split where fewer are needed. Every step uses up a
    length or a pattern, so that there are never more than about two patterns for each length."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    left = dict(sorted(histogram.items(), reverse=True))
    for length, n in left.items():
        while n:
            # the exact fit closes a pack; otherwise the shortest pack
            space = length if open_.get(length) else max((s for s, packs in open_.items() if packs and s >= length), default=None)
            if space is None:
                many = window // length
                k = n // many if n >= many else 1
                put = [length] * (many if n >= many else n)
                open_.setdefault(window - length * len(put), []).append((k, put))
                n -= k * len(put)
                continue
            count, held = open_[space].pop()
            each = max(1, min(space // length, n // count if count <= n else 1)) if space != length else 1
            take = min(count, n // each)
            if take < count:
                open_[space].append((count - take, held))
            open_.setdefault(space - each * length, []).append((take, held + [length] * each))
            n -= take * each
    return [pack for packs in open_.values() for pack in packs]


def slots(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): where the pieces of each length go."""
    out, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, lengths in sorted(patterns(histogram, window), key=lambda p: (p[1], p[0]), reverse=True):
        offset = 0
        for length in lengths:
            out.append((length, rank[length], rank[length] + count, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    A document's ids, with END behind them, are cut at whole windows; the histogram of the rests (at most
    ``window`` counts) is packed on the driver. A piece's rank among those of its length comes from counts by
    (length, chunk of ids), so that a length which a third of all pieces have is ranked in many tasks. Defined
    cases: a null text counts as empty, and an empty one is the one id END; repeated rows are packed each;
    other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path or vocabulary(), doc_id, text, window), "packing-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    chunks = max(1, sum(histogram.values()) // 20000)
    placed = cut.withColumn("chunk", F.pmod(F.xxhash64("id", "start"), F.lit(chunks)))
    by_chunk = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("length", "chunk").count().select("length", "chunk", F.coalesce(F.sum("count").over(by_chunk), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "chunk").orderBy("id", "start", "ids_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    # bounded by the window: see patterns()
    table = spark.createDataFrame(slots(histogram, window), "slot_length long, first long, last long, sequence long, offset long")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return ranked.join(F.broadcast(table), fits).select(
        F.col("id").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
