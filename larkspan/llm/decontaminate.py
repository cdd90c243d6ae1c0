"""Benchmark items in documents: gapped character seeds, bit-parallel edit distance of all candidates, exact alignment.

Items and documents are looked at without white space and marks. A seed is two runs of four characters, side by side or
with one character between them on either side, so that it spans an edit: a passage keeps seeds where its edits lie
evenly, once a word or every five characters, as well as where they leave longer runs. A stretch of a document in which
an item has enough seeds at like places is held against the item's pieces of 64 characters by Myers's algorithm, for
thousands of stretches at once; the pieces' distances add up to no more than the item's. What is near enough is then
aligned exactly, with all characters. No condition on words comes before that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import text_of
from larkspan.llm.shingles import mix

_U = np.uint64
_MUL = _U(0xD6E8FEB86659FD93)
SIMILARITY = 0.8
#: Items of fewer words and characters are looked for without edits, and only where no letter or digit stands beside.
LEAST_WORDS, LEAST_CHARS = 5, 25
#: Of k random edits' gaps so many are expected to be as long as a seed: a passage without one has a chance of exp(-KEPT).
KEPT = 2.8
MOST_SEED = 16
#: Items with fewer letters and digits than this, or with fewer than the share, are looked for by plain seeds instead.
LEAST_FOLDED, LEAST_SHARE = 32, 0.7
#: Seeds in so many places an item must have in two neighbouring stretches, fewer if it has fewer than as many times
#: EACH characters; and how many places of one seed in an item count.
NEEDED, EACH, PLACES = 6, 30, 4
#: Pairs of places that are held at once.
HELD = 1 << 20
#: Characters of items that are looked for at once; more items take more passes over the documents.
PARCEL = 2_000_000
#: Characters of documents in a block, and places aligned at once.
BLOCK, ALIGNED = 1 << 20, 2048
#: The bitmap of the shortest prefixes has 2 ** BITS cells.
BITS = 21


def edits(n_chars: int, n_words: int, similarity: float) -> int:
    """The most edits with which an item is still found; a similarity of exactly the least one counts."""
    return int((1 - similarity) * n_chars + 1e-9) if n_words >= LEAST_WORDS or n_chars >= LEAST_CHARS else 0


def seed_length(n_chars: int, k: int, similarity: float) -> int:
    """The length of an item's seeds. One of n // (k + 1) characters is always kept; random edits keep longer ones."""
    longer = int(log(k / KEPT) / -log(similarity)) if k > KEPT and similarity < 1 else 0
    return max(1, min(max(n_chars // (k + 1), longer), MOST_SEED))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(codes: np.ndarray) -> np.ndarray:
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, np.where((codes >= 9) & (codes <= 13), 32, codes))
    return ((codes ^ (codes >> 8)) & 255).astype(np.uint8)


def symbols(text: str) -> np.ndarray:
    """A byte for each character, A-Z as lower case and white space as a space; rare characters may share one."""
    return _symbols(_codes(text))


_ALNUM = np.array([chr(c).isalnum() for c in range(0x3100)])


def _kept(codes: np.ndarray) -> np.ndarray:
    """Where letters and digits are; beyond the marks of CJK all characters count as letters."""
    return _ALNUM[np.minimum(codes, len(_ALNUM) - 1)] | (codes >= len(_ALNUM))


def _extend(h: np.ndarray, codes: np.ndarray, at: np.ndarray, a: int, b: int) -> np.ndarray:
    for j in range(a, b):
        h = h * _MUL + codes[at + j] + _U(1)
    return h


class Seeds:
    """The items (id, text) of a parcel, with their symbols for the alignment and both kinds of seeds."""

    def __init__(self, items: list[tuple], similarity: float):
        self.items = [(i, t) for i, t in items if t.split()]
        self.codes = [symbols(t) for _, t in self.items]
        words = [len(t.split()) for _, t in self.items]
        self.verbatim = [w < LEAST_WORDS and len(c) < LEAST_CHARS for c, w in zip(self.codes, words)]
        self.most = np.array([edits(len(c), w, similarity) for c, w in zip(self.codes, words)], np.int64)
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        where = [np.flatnonzero(_kept(_codes(t))) for _, t in self.items]
        folds = [len(w) >= max(LEAST_FOLDED, LEAST_SHARE * len(c)) for w, c in zip(where, self.codes)]
        folded = [(x, c[w], w) for x, (c, w) in enumerate(zip(self.codes, where)) if folds[x]]
        self.pairs = PairSeeds(folded, (False, True), (False, True))
        # with white space and marks an edit's neighbours are others: characters replaced at even distances
        self.spaced = PairSeeds([(x, self.codes[x], np.arange(len(self.codes[x]))) for x, _, _ in folded], (True,), (False, True))
        self.plain = PlainSeeds([(x, c, seed_length(len(c), k, similarity)) for x, (c, k) in enumerate(zip(self.codes, self.most)) if not folds[x]])

    @lru_cache(maxsize=4000)  # noqa: B019
    def masks(self, x: int) -> np.ndarray:
        """For each symbol and word of 64 bits, where the item has the symbol."""
        c = self.codes[x]
        out = np.zeros((256, (len(c) + 63) // 64), _U)
        for i, s in enumerate(c):
            out[s, i >> 6] |= _U(1 << (i & 63))
        return out

    def stretches(self, codes: np.ndarray, kept: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number of the text, item, first and last place where the item seems to begin) of stretches of half an item.

        Places are joined to stretches as they are found, so that neither a text nor an item that repeats itself, nor
        a seed that very many items have, makes many pairs of places to hold."""
        where = np.flatnonzero(kept)
        seen = chain(((where[at], item, place) for at, item, place in self.pairs.found(codes[where])), self.spaced.found(codes))
        parts = [self._joined(seen, begins, NEEDED), self._joined(self.plain.found(codes), begins, 1)]
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))

    def _joined(self, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], begins: np.ndarray, needed: int):
        held = tuple(np.zeros(0, np.int64) for _ in range(6))
        for at, item, place in found:
            start = at - place
            step = start // np.maximum(self.sizes[item] // 2, 1)
            order = np.lexsort((at, step, item))
            at, item, step, start = at[order], item[order], step[order], start[order]
            owner = np.searchsorted(begins, at, side="right") - 1
            # seeds that overlap are one piece of evidence
            apart = np.append(True, (at[1:] // 8 != at[:-1] // 8) | (step[1:] != step[:-1]) | (item[1:] != item[:-1]))[: len(at)].astype(np.int64)
            held = _summed(*(np.concatenate(x) for x in zip(held, (owner, item, step, start, start, apart))))
        owner, item, step, low, high, n = held
        if needed > 1 and len(n):
            # seeds of one passage may lie in two neighbouring stretches
            after = (owner[1:] == owner[:-1]) & (item[1:] == item[:-1]) & (step[1:] == step[:-1] + 1)
            both = np.where(after, n[1:] + n[:-1], 0)
            total = np.maximum(n, np.maximum(np.append(both, 0), np.append(0, both)))
            enough = total >= np.minimum(needed, self.sizes[item] // EACH)
            owner, item, low, high = (x[enough] for x in (owner, item, low, high))
        return owner, item, low, high


def _summed(owner, item, step, low, high, n):
    """One row for each (owner, item, step), in their order."""
    order = np.lexsort((step, item, owner))
    owner, item, step, low, high, n = (x[order] for x in (owner, item, step, low, high, n))
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (step[1:] != step[:-1]))[: len(owner)])
    if not len(first):
        return owner, item, step, low, high, n
    return owner[first], item[first], step[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(n, first)


def _few_places(keys: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In order of the keys; of a key that an item has often, its first PLACES places."""
    order = np.lexsort((place, item, keys))
    keys, item, place = keys[order], item[order], place[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]))[: len(keys)]
    first = np.flatnonzero(new)
    few = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys)))) < PLACES
    return keys[few], item[few], place[few]


def _expanded(at: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (place, item, place in the item), about HELD of them at a time."""
    times = high - low
    total = np.cumsum(times)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HELD, side="right")))
        t = times[a:b]
        which = np.repeat(low[a:b], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        yield np.repeat(at[a:b], t), item[which], place[which]
        a = b


_LOW, _HIGH, _ODD = _U(0xFFFFFFFF), _U(0xFFFFFFFF << 32), _U(0x9E3779B97F4A7C15)


def _eights(codes: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray((max(len(codes) - 7, 0),), "<u8", np.ascontiguousarray(codes), 0, (1,))


def _gapped(eights: np.ndarray) -> np.ndarray:
    """The same with one more character between the fourth and the fifth."""
    return (eights[:-1] & _LOW) | (eights[1:] & _HIGH)


class PairSeeds:
    """Two runs of four characters, side by side or with a character between them, of items (number, symbols, where
    these are in the item): with the ``gaps`` in items, and those ``asked`` for in texts."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], gaps: tuple[bool, ...], asked: tuple[bool, ...]):
        self.asked = asked
        keys_of = lambda c: [_gapped(_eights(c)) if gap else _eights(c) for gap in gaps]
        made = [(k, np.full(len(k), x), w[: len(k)]) for x, c, w in items for k in keys_of(c)]
        keys, item, place = (np.concatenate([m[j] for m in made]) if made else np.zeros(0, t) for j, t in enumerate((_U, np.int64, np.int64)))
        self.keys, self.item, self.place = _few_places(keys, item, place)
        self.bits = min(26, max(16, int(16 * len(self.keys)).bit_length()))
        self.cells = np.zeros(1 << self.bits, bool)
        self.cells[self._cell(self.keys)] = True

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> _U(64 - self.bits)).view(np.int64)

    def found(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in ``codes``, items, places in the items) at which both have the same seed, with or without a gap on
        either side."""
        eights = _eights(codes)
        if not len(self.keys):
            return
        for a in range(0, len(eights), HELD):
            some, keys = [], []
            for x in range(a, min(a + HELD, len(eights)), 1 << 15):
                own = eights[x : x + (1 << 15) + 1].copy()
                for key in (_gapped(own) if gap else own[: 1 << 15] for gap in self.asked):
                    at = np.flatnonzero(self.cells[self._cell(key)])
                    some.append(at + x)
                    keys.append(key[at])
            at, key = np.concatenate(some), np.concatenate(keys)
            low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
            has = high > low
            yield from _expanded(at[has], low[has], high[has], self.item, self.place)


class PlainSeeds:
    """All runs of a length of items (number, symbols, length), for short items and those of other signs."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]]):
        self.lengths = sorted({n for _, _, n in items})
        self.hits, self.prefixes = {}, {}
        made = {n: [] for n in self.lengths}
        for x, c, n in items:
            starts = np.arange(len(c) - n + 1)
            h, done = np.zeros(len(starts), _U), 0
            for m in self.lengths:
                if m <= n:
                    h, done = _extend(h, c, starts, done, m), m
                    made[m].append((mix(h), np.full(len(starts), x), starts, m == n))
        for n, parts in made.items():
            self.prefixes[n] = np.unique(np.concatenate([p[0] for p in parts]))
            own = [p for p in parts if p[3]]
            self.hits[n] = _few_places(*(np.concatenate([p[k] for p in own]) for k in range(3)))
        self.first = np.zeros(1 << BITS, bool)
        if self.lengths:
            self.first[self._cell(self.prefixes[self.lengths[0]])] = True

    @staticmethod
    def _cell(keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - BITS)).astype(np.int64)

    def found(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in ``codes``, items, places in the items) at which both have the same seed."""
        if not self.lengths:
            return
        n, alive, hashes = self.lengths[0], [], []
        for a in range(0, len(codes) - n + 1, 1 << 15):
            b = min(a + (1 << 15), len(codes) - n + 1)
            h = np.zeros(b - a, _U)
            for j in range(n):
                h *= _MUL
                h += codes[a + j : b + j]
                h += _U(1)
            some = np.flatnonzero(self.first[self._cell(mix(h))])
            alive.append(some + a)
            hashes.append(h[some])
        at, h = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((alive, np.int64), (hashes, _U)))
        done = n
        for n in self.lengths:
            inside = at + n <= len(codes)
            at, h = at[inside], _extend(h[inside], codes, at[inside], done, n)
            done, key, listed = n, mix(h), self.prefixes[n]
            if not len(at):
                return
            some = listed[np.minimum(np.searchsorted(listed, key), len(listed) - 1)] == key
            at, h, key = at[some], h[some], key[some]
            keys, item, place = self.hits[n]
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            yield from _expanded(at, low, high, item, place)


def piece_distances(seeds: Seeds, item: np.ndarray, piece: int, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row the least edit distance of a piece of its item, 64 symbols at most, to a part of
    ``codes[low:high]``; at most the distance of the characters."""
    kinds, row = np.unique(item, return_inverse=True)
    masks = np.stack([seeds.masks(int(x))[:, piece] for x in kinds]).ravel()
    row = row * 256
    score = np.minimum(seeds.sizes[item] - 64 * piece, 64)
    top, one, best = (score - 1).astype(_U), _U(1), score.copy()
    up, down = np.full(len(item), ~_U(0)), np.zeros(len(item), _U)
    steps, last = high - low, len(codes) - 1
    shortest = int(steps.min())
    for j in range(int(steps.max())):
        eq = masks[row + codes[np.minimum(low + j, last)]]
        if j >= shortest:
            eq[j >= steps] = 0
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(h | up), up & h
        score += ((plus >> top) & one).view(np.int64)
        score -= ((minus >> top) & one).view(np.int64)
        np.minimum(best, score, out=best)
        plus <<= one
        minus <<= one
        up, down = minus | ~(v | plus), plus & v
    return best


def best_match(pattern: str, text: str) -> tuple[int, int, int]:
    """(edit distance, start, end) of the substring of ``text`` nearest to ``pattern``; the earliest end of those."""

    def search(p: str, t: str) -> tuple[int, int]:
        m = len(p)
        mask, top = (1 << m) - 1, 1 << (m - 1)
        where: dict[str, int] = {}
        for i, c in enumerate(p):
            where[c] = where.get(c, 0) | 1 << i
        up, down, score, best, end = mask, 0, m, m, 0
        for j, c in enumerate(t, 1):
            eq = where.get(c, 0)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus = (down | ~(h | up)) & mask
            minus = up & h
            score += bool(plus & top) - bool(minus & top)
            plus, minus = (plus << 1) & mask, (minus << 1) & mask
            up, down = (minus | ~(v | plus)) & mask, plus & v
            if score < best:
                best, end = score, j
        return best, end

    distance, end = search(pattern, text)
    _, back = search(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


_LOWER = str.maketrans({**{chr(c): chr(c + 32) for c in range(65, 91)}, **{chr(c): " " for c in range(9, 14)}})


def matches(seeds: Seeds, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, start, end, distance) of the passages of a block of texts."""
    raw = [_codes(t) for t in texts]
    codes = np.concatenate([np.append(_symbols(c), np.uint8(0)) for c in raw])
    kept = np.concatenate([np.append(_kept(c), True) for c in raw])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner, item, start, till = seeds.stretches(codes, kept, begins)
    if not len(owner):
        return
    most = seeds.most[item]
    low = np.maximum(start - most, begins[owner])
    high = np.minimum(till + seeds.sizes[item] + most, begins[owner + 1] - 1)
    # the pieces' distances add up to no more than the item's
    left, some, piece = most.copy(), np.arange(len(item)), 0
    passed = []
    while len(some):
        ends = np.minimum(seeds.sizes[item], 64 * (piece + 1))
        a, b = np.maximum(low, start - most + 64 * piece), np.minimum(high, till + most + ends)
        b = np.maximum(a, b)
        some = some[np.argsort((b - a)[some], kind="stable")]
        for x in range(0, len(some), ALIGNED):
            k = some[x : x + ALIGNED]
            left[k] -= piece_distances(seeds, item[k], piece, codes, a[k], b[k])
        some, piece = some[left[some] >= 0], piece + 1
        whole = seeds.sizes[item[some]] <= 64 * piece
        passed.append(some[whole])
        some = some[~whole]
    got: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k in np.sort(np.concatenate(passed)):
        doc, x = int(owner[k]), int(item[k])
        a = int(low[k] - begins[doc])
        pattern, text = seeds.items[x][1].translate(_LOWER), texts[doc]
        body = text[a : int(high[k] - begins[doc])].translate(_LOWER)
        if seeds.verbatim[x]:
            beside = (text[max(a - 1, 0) : a] + pattern[:1]).isalnum() * a or (pattern[-1:] + text[a + len(pattern) : a + len(pattern) + 1]).isalnum() * (a + len(pattern) < len(text))
            if body == pattern and not beside:
                got.setdefault((doc, x), []).append((0, a, a + len(pattern)))
            continue
        distance, s, e = best_match(pattern, body)
        if distance <= most[k]:
            got.setdefault((doc, x), []).append((distance, a + s, a + e))
    for (doc, x), hits in got.items():
        begun: list[int] = []
        ended: list[int] = []
        for distance, a, b in sorted(set(hits)):
            k = bisect_left(begun, b)  # those before k begin before the passage ends
            if not k or ended[k - 1] <= a:
                begun.insert(k, a)
                ended.insert(k, b)
                yield doc, x, a, b, distance


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From where to where texts of about BLOCK characters reach."""
    a = size = 0
    for b, text in enumerate(texts, 1):
        size += len(text)
        if size >= BLOCK or b == len(texts):
            yield a, b
            a, size = b, 0


def _scan(sent, schema: list[str]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = sent.value
        for batch in batches:
            ids, texts = batch["id"].to_numpy(), list(batch["text"])
            for a, b in _blocks(texts):
                rows = [(ids[a + d], seeds.items[x][0], s, e, n, 1 - n / len(seeds.items[x][1])) for d, x, s, e, n in matches(seeds, texts[a:b])]
                if rows:
                    yield pd.DataFrame(rows, columns=schema)

    return scan


def _clean(sent):
    """A function from texts to whether none of the seeds' items is in them."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out, whole = np.ones(len(texts), bool), list(texts)
        for a, b in _blocks(whole):
            out[[a + d for d, *_ in matches(sent.value, whole[a:b])]] = False
        return pd.Series(out)

    return clean


def _parcels(items: DataFrame, item_id: str, text: str, similarity: float) -> Iterator:
    """The broadcast seeds of about PARCEL characters of items at a time."""
    known = items.select(F.col(f"`{item_id}`").alias("item_id"), text_of(text).alias("text")).where(F.col("text") != "")
    parcels = ceil((known.agg(F.sum(F.length("text"))).first()[0] or 0) / PARCEL)
    for k in range(parcels):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parcels)) == k).collect()
        seeds = Seeds([(r["item_id"], r["text"]) for r in part], similarity)
        if seeds.items:
            yield items.sparkSession.sparkContext.broadcast(seeds)


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance, similarity): passages of documents that are items, or nearly.

    ``distance`` is the edit distance in characters, where A-Z counts as lower case and each white-space character
    as a space; passages of at least the given similarity (1 - distance / the item's length) are returned, the
    nearest of those that overlap. Start and end are in characters. What is broadcast is a parcel of items of a
    fixed size, with its seeds; there are as many passes over the documents as parcels. Defined cases: a null or
    empty text has no items; items that are null or have no words are left out; those of fewer than LEAST_WORDS
    words and LEAST_CHARS characters are found verbatim, between characters that are no letters or digits; items that
    repeat are found each under its id; a repeated document repeats its rows, and rows of one id or of none are
    searched each; other columns are ignored; an empty table on either side gives no row.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(f"`{doc_id}`").alias("id"), text_of(text).alias("text"))
    kinds = body.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    found = f"id {kinds[0]}, item_id {kinds[1]}, start long, end long, distance int, similarity double"
    names = [F.col("id").alias(doc_id), F.col("item_id").alias(item_id), "start", "end", "distance", "similarity"]
    out = None
    for sent in _parcels(items, item_id, text, similarity):
        rows = body.mapInPandas(_scan(sent, ["id", "item_id", "start", "end", "distance", "similarity"]), found)
        out = rows if out is None else out.unionByName(rows)
    return (spark.createDataFrame([], found) if out is None else out).select(names)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents in which an item is found; columns stay as they are.

    Each row is judged by its own text where it lies, without a join, so that null or repeated ids and repeated rows
    stay or go as their texts do; a null or empty text stays; items as for :func:`find_items`."""
    for sent in _parcels(items, item_id, text, similarity):
        docs = docs.where(_clean(sent)(text_of(text)))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
