"""Exact removal of repeated byte strings by ranks of sampled suffixes at growing reaches.

A suffix array over every byte would sort each of them once a doubling. Here the positions are sampled first: of the
K-byte strings in each window of REACH bytes, the one with the least hash is its anchor, so that equal windows have
equal anchors at equal places. Anchors are ranked by their K bytes; unique ones end there. The others are ranked
again over all that a window around them can reach, and those that repeat an earlier anchor so far are repeated with
all their windows. Only the first of each rank goes on, if its anchor has others: for these, ranks at every byte
double from 8 to 64 bytes, and pairs of ranks at an offset of 36 give those of 100.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larkspan.llm.common import shuffle_partitions, stored, text_of, version
from larkspan.llm.shingles import mix, power_tables

_U = np.uint64
#: The threshold, and the bytes of an anchor.
REACH, K = 100, 24
#: The most bytes of a window before its anchor.
BACK = REACH - K
_MUL = _U(0xD6E8FEB86659FD93)
#: Anchors that one task ranks.
TASK_ANCHORS = 2_000_000
_POSITION = 20
#: Contexts ranked at every byte at a time.
STEP = 8000
#: The windows of an anchor with more open ones than this are dealt out one by one, by their rank.
HOT = 2000
#: Anchors with about so many places, by an estimate from one document in SAMPLED, don't even meet in a task to be
#: ranked; MOST_HOT of them at most.
CROWDED, SAMPLED, MOST_HOT = 20_000, 16, 1 << 20


def anchors(body: bytes) -> tuple[np.ndarray, ...] | None:
    """Rank by K bytes, rank by whole reach, position, first window and number of windows of each anchor."""
    n = len(body)
    if n < REACH:
        return None
    powers, inverses = power_tables(n + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((np.frombuffer(body, np.uint8).astype(_U) + _U(1)) * powers[:n])])
    grams = mix((total[K:] - total[:-K]) * inverses[: n - K + 1])
    found = []
    # a position is held in the low bits of its hash, so that very long texts go in parts
    most = (1 << _POSITION) - REACH
    for first in range(0, n - REACH + 1, most):
        part = grams[first : first + most + BACK]
        least = (part >> _U(_POSITION) << _U(_POSITION)) | np.arange(len(part), dtype=_U)
        span = 1
        while span * 2 <= BACK + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = BACK + 1 - span
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        found.append((least & _U((1 << _POSITION) - 1)).astype(np.int64) + first)
    place = np.concatenate(found)
    window = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    position = place[window]
    low, high = np.maximum(position - BACK, 0), np.minimum(position + REACH, n)
    reach = mix((total[high] - total[low]) * inverses[low] + (position - low).astype(_U) * _U(1000) + (high - position).astype(_U))
    return grams[position], reach, position, window, np.diff(np.append(window, len(place)))


def _top(values: np.ndarray, size: int) -> np.ndarray:
    """The top bytes of 64-bit numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :])


def _number(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.reshape(-1).view("<u8")


_PARCELS = "bucket int, hot boolean, ids binary, counts binary, ranks binary, reaches binary, positions binary, sides binary"
_MARKS = ["id", "start", "windows", "position", "rank", "hot"]


def _ranks_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ranks that a batch has more than once, by the top 48 bits."""
    for batch in batches:
        found = [a[0] for t in batch["text"] if (a := anchors(t.encode("utf-8", "surrogatepass")))]
        if found:
            ranks, times = np.unique(np.concatenate(found) >> _U(16), return_counts=True)
            yield pd.DataFrame({"rank": ranks[times > 1].astype(np.int64), "times": times[times > 1]})


def crowded_ranks(body: DataFrame, least: int = CROWDED) -> np.ndarray:
    """Ranks so frequent that their anchors shouldn't meet in a task, sorted.

    This decides where anchors travel, never what is removed: any list gives the same result, as every task has the
    same. So it is estimated from one document in SAMPLED, and ``least`` is doubled until MOST_HOT suffice."""
    some = body.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("text").mapInPandas(_ranks_seen, "rank long, times long")
    counted = stored(some.groupBy("rank").agg((F.sum("times") * SAMPLED).alias("times")).where(F.col("times") >= least), "substrings-crowded")
    while counted.where(F.col("times") >= least).count() > MOST_HOT:
        least *= 2
    return np.sort(counted.where(F.col("times") >= least).toPandas()["rank"].to_numpy(np.int64).astype(_U))


def _send_anchors(n: int, crowded, batch_anchors: int = 400_000):
    """The anchors of many documents, a parcel for each bucket of ranks: 19 bytes an anchor.

    Those of crowded ranks go by way of any task, and of those with one rank and reach only the first does; the
    others, which repeat it as far as a window can reach, are marked so with their rank left out."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = crowded.value
        held: list[tuple] = []
        ids: list[int] = []

        def parcel(bucket: int, hot: bool, o: np.ndarray, owner, rank, reach, position, window, windows) -> tuple:
            own, counts = np.unique(owner[o], return_counts=True)
            sides = np.stack([position[o] - window[o], windows[o]], 1).astype(np.uint8)
            return bucket, hot, np.array(ids, "<i8")[own].tobytes(), counts.astype("<u4").tobytes(), _top(rank[o], 6).tobytes(), _top(reach[o], 7).tobytes(), position[o].astype("<u4").tobytes(), sides.tobytes()

        def flush() -> pd.DataFrame:
            rank, reach, position, window, windows = (np.concatenate([h[k] for h in held]) for k in range(5))
            owner = np.repeat(np.arange(len(ids)), [len(h[0]) for h in held])
            rows, plain = [], np.arange(len(rank))
            if len(known):
                short = rank >> _U(16)
                is_hot = known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
                hot, plain = np.flatnonzero(is_hot), np.flatnonzero(~is_hot)
                order = hot[np.lexsort((position[hot], np.array(ids)[owner[hot]], reach[hot], rank[hot]))]
                again = np.concatenate([[False], (rank[order][1:] == rank[order][:-1]) & (reach[order][1:] == reach[order][:-1])])[: len(order)]
                rank = rank.copy()
                rank[order[again]] = 0
                if len(hot):
                    rows.append(parcel(int(rank.sum() % _U(n)), True, hot, owner, rank, reach, position, window, windows))
            bucket = (rank[plain] % _U(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(n + 1))
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if b > a:
                    rows.append(parcel(k, False, plain[order[a:b]], owner, rank, reach, position, window, windows))
            held.clear()
            ids.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _PARCELS.split(", ")])

        size = 0
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                if found := anchors(text.encode("utf-8", "surrogatepass")):
                    held.append(found)
                    ids.append(key)
                    size += len(found[0])
                    if size >= batch_anchors:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return send


def _rank(most: int):
    """Of the anchors that aren't unique: those that repeat an earlier one as far as a window can reach, and, as
    open, the first of each such rank where the anchor has more than one; as hot too where it has over ``most``."""

    def opened(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
        raw = lambda c, kind: np.frombuffer(b"".join(group[c]), kind)
        ids = np.repeat(raw("ids", "<i8"), raw("counts", "<u4"))
        rank, reach = _number(raw("ranks", np.uint8).reshape(-1, 6)), _number(raw("reaches", np.uint8).reshape(-1, 7))
        return ids, rank, reach, raw("positions", "<u4"), raw("sides", np.uint8).reshape(-1, 2)

    def marks(ids, rank, position, sides, hot) -> pd.DataFrame:
        columns = ids, position.astype(np.int64) - sides[:, 0], sides[:, 1].astype(np.int32), position.astype(np.int64), rank, hot
        return pd.DataFrame(dict(zip(_MARKS, columns)))

    def rank_group(group: pd.DataFrame) -> pd.DataFrame:
        ids, rank, _, position, sides = opened(group[group["hot"]])
        passed = marks(ids, np.where(rank > 0, rank.astype(np.int64), -1), position, sides, rank > 0)
        ids, rank, reach, position, sides = opened(group[~group["hot"]])
        by_rank = np.argsort(rank, kind="stable")
        sizes = np.diff(np.append(starts := np.flatnonzero(np.concatenate([[True], np.diff(rank[by_rank]) != 0])), len(rank)))
        again = by_rank[np.repeat(sizes, sizes) > 1]
        ids, rank, reach, position, sides = ids[again], rank[again], reach[again], position[again], sides[again]
        order = np.lexsort((position, ids, reach, rank))
        ids, rank, reach, position, sides = ids[order], rank[order], reach[order], position[order], sides[order]
        fresh_rank = np.concatenate([[True], np.diff(rank) != 0])[: len(rank)]
        fresh = fresh_rank | np.concatenate([[True], np.diff(reach) != 0])[: len(rank)]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(rank)), 0)) if len(rank) else np.zeros(0, int)
        repeats = (ids != ids[first]) | (position != position[first])
        of_rank = np.cumsum(fresh_rank) - 1
        kinds = np.bincount(of_rank, weights=fresh, minlength=1)
        is_open = fresh & (kinds[of_rank] > 1) if len(rank) else fresh
        hot = is_open & (kinds[of_rank] > most) if len(rank) else is_open
        return pd.concat([passed, marks(ids, np.where(is_open, rank.astype(np.int64), -1), position, sides, hot)[repeats | is_open]])

    return rank_group


def _packed(docs: DataFrame) -> DataFrame:
    """The texts as zstd blocks, to be dealt out; the other columns come first."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = batch.drop(columns="text")
            out["body"] = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield out

    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInPandas(pack, ", ".join([*others, "body binary"]))


_SENT = "bucket int, kind int, numbers binary, contexts binary"
_CONTEXTS, _WINDOWS, _SPANS = range(3)


def _send_contexts(n: int):
    """What is around the open anchors, to where their rank is resolved. Of a hot anchor the windows' ranks are
    sent, the first of each in this batch alone; the others are spans to go already."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, hot = [], []
            for key, body, marks in zip(batch["id"], batch["body"], batch["marks"]):
                text = bytes(BACK) + unpress.decompress(body, max_output_size=1 << 31) + bytes(REACH)
                for m in marks:
                    p = m["position"]
                    (hot if m["hot"] else rows).append((m["rank"] % n, m["rank"], key, p, m["start"], m["windows"], text[p : p + BACK + REACH]))
            rows.sort(key=lambda r: r[0])
            out, a = [], 0
            while a < len(rows):
                b = a
                while b < len(rows) and rows[b][0] == rows[a][0]:
                    b += 1
                numbers = np.array([r[1:6] for r in rows[a:b]], "<i8")
                out.append((rows[a][0], _CONTEXTS, numbers.tobytes(), b"".join(r[6] for r in rows[a:b])))
                a = b
            if hot:
                numbers = np.array([r[1:6] for r in hot], "<i8")
                names, ids, at = _windows_of(numbers, np.frombuffer(b"".join(r[6] for r in hot), np.uint8).reshape(-1, BACK + REACH))
                order = np.lexsort((at, ids, names))
                names, ids, at = names[order], ids[order], at[order]
                first, repeats = _first_and_repeats(names, ids, at)
                spans = _spans(ids[repeats], at[repeats])
                out.append((int(spans.sum() % n), _SPANS, spans.tobytes(), b""))
                names, ids, at = names[first], ids[first], at[first]
                bucket = (names % _U(n)).astype(np.int64)
                for k in np.unique(bucket):
                    own = bucket == k
                    out.append((int(k), _WINDOWS, np.stack([names[own].astype(np.int64), ids[own], at[own]], 1).astype("<i8").tobytes(), b""))
            yield pd.DataFrame(out, columns=["bucket", "kind", "numbers", "contexts"])

    return send


def window_ranks(contexts: np.ndarray) -> np.ndarray:
    """For each context (BACK bytes, then REACH from the anchor on) the rank of its window at each of BACK + 1
    starts: bytes in eights, doubled at offsets 8, 16 and 32, then 64 and 64 at an offset of 36."""
    ranks = np.zeros((len(contexts), contexts.shape[1] - 7), _U)
    for k in range(8):
        ranks |= contexts[:, k : k + ranks.shape[1]].astype(_U) << _U(8 * k)
    ranks = mix(ranks)
    for offset in (8, 16, 32, REACH - 64):
        ranks = mix(ranks[:, :-offset] * _MUL + ranks[:, offset:])
    return ranks


def _own_windows(contexts: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and rank of each context's own windows."""
    columns = np.arange(BACK + 1, dtype=np.int16)[None, :]
    row, column = np.nonzero((columns >= first[:, None]) & (columns < (first + windows)[:, None]))
    return row.astype(np.int32), column.astype(np.int16), window_ranks(contexts)[row, column]


def _windows_of(numbers: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, document and start of all own windows of contexts with (rank, id, position, start, windows)."""
    _, ids, position, start, windows = numbers.T
    names, owners, starts = [], [], []
    for k in range(0, len(numbers), STEP):
        part = slice(k, k + STEP)
        row, column, name = _own_windows(contexts[part], start[part] - position[part] + BACK, windows[part])
        names.append(name)
        owners.append(ids[part][row])
        starts.append(position[part][row] - BACK + column)
    return np.concatenate(names), np.concatenate(owners), np.concatenate(starts)


def _first_and_repeats(names: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in the order of rank, document and start: which are the first of their rank, and which repeat it."""
    fresh = np.concatenate([[True], names[1:] != names[:-1]])[: len(names)]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(names)), 0))
    return fresh, (ids != ids[head]) | (at != at[head])


def _spans(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (id, start, end) of the bytes under windows, those at consecutive starts in one."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(at) > 1)])[: len(ids)]
    last = np.concatenate([new[1:], [True]])[: len(ids)]
    return np.stack([ids[new], at[new], at[last] + REACH], 1).astype("<i8")


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    """The windows of open anchors that repeat an earlier one's, as spans of bytes."""
    raw = lambda kind, width: np.frombuffer(b"".join(group.loc[group["kind"] == kind, "numbers"]), "<i8").reshape(-1, width)
    found = [raw(_SPANS, 3)]
    windows = raw(_WINDOWS, 3)
    windows = windows[np.lexsort((windows[:, 2], windows[:, 1], windows[:, 0]))]
    _, repeats = _first_and_repeats(*windows.T)
    found.append(_spans(windows[repeats, 1], windows[repeats, 2]))

    numbers = raw(_CONTEXTS, 5)
    contexts = np.frombuffer(b"".join(group["contexts"]), np.uint8).reshape(-1, BACK + REACH)
    order = np.argsort(numbers[:, 0], kind="stable")
    numbers, contexts = numbers[order], contexts[order]
    a = 0
    while a < len(numbers):  # whole anchors' groups, of about STEP contexts
        b = int(np.searchsorted(numbers[:, 0], numbers[min(a + STEP, len(numbers)) - 1, 0], side="right"))
        names, ids, at = _windows_of(numbers[a:b], contexts[a:b])
        order = np.lexsort((at, ids, names))
        names, ids, at = names[order], ids[order], at[order]
        _, repeats = _first_and_repeats(names, ids, at)
        found.append(_spans(ids[repeats], at[repeats]))
        a = b
    return pd.DataFrame(np.concatenate(found), columns=["id", "start", "end"])


def keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """Rows (own, id, text), and the number of characters. ``id`` is a number that orders documents as ``own`` does.

    Where every row has an integer of its own, that is the id itself. Otherwise (ids that are null, no integers, or on
    rows with different texts) it is the place of (own, text's version) in their order; nulls come last."""
    body = docs.select(F.col(f"`{doc_id}`").alias("own"), version(text).alias("v"), text_of(text).alias("text"))
    by_id = body.groupBy("own").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.length("text")).alias("size"))
    odd, size = by_id.agg(F.coalesce(F.max((F.col("low") < F.col("high")) | F.col("own").isNull()), F.lit(False)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not odd and isinstance(body.schema["own"].dataType, IntegralType):
        return body.select("own", F.col("own").cast("long").alias("id"), "text"), size
    # the ids grow with the partitions, and these with the order
    order = body.select("own", "v").distinct().orderBy(F.col("own").asc_nulls_last(), "v")
    known = stored(order.select(F.col("own").alias("its_own"), F.col("v").alias("its_v"), F.monotonically_increasing_id().alias("id")), "substrings-order")
    found = body.join(known, body["own"].eqNullSafe(known["its_own"]) & (body["v"] == known["its_v"]))
    return found.select("own", "id", "text"), size


def repeated_spans(body: DataFrame, size: int, hot: int = HOT, crowded: int = CROWDED) -> DataFrame:
    """Rows (id, spans), from rows (id, text): for each document with repeated strings the bytes (start, end) that go.

    Spans of one document may overlap. A string of REACH bytes goes where it also starts earlier: in a document
    with a smaller id, or before in the same one."""
    spark = body.sparkSession
    n = max(shuffle_partitions(spark), size // 30 // TASK_ANCHORS)
    known = spark.sparkContext.broadcast(crowded_ranks(body, crowded))
    parcels = body.mapInPandas(_send_anchors(n, known), _PARCELS)
    marks = stored(parcels.groupBy("bucket").applyInPandas(_rank(hot), "id long, start long, windows int, position long, rank long, hot boolean"), "substrings-marks")

    of_open = marks.where("rank >= 0").groupBy("id").agg(F.collect_list(F.struct("rank", "position", "start", "windows", "hot")).alias("marks"))
    sent = _packed(body).join(of_open, "id").mapInPandas(_send_contexts(n), _SENT)
    resolved = sent.groupBy("bucket").applyInPandas(_resolve, "id long, start long, end long")
    whole = marks.where("rank < 0").select("id", "start", (F.col("start") + F.col("windows") - 1 + REACH).alias("end"))
    spans = whole.unionByName(resolved).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return stored(spans, "substrings-spans")


def _without(body: bytes, spans) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what stays."""
    if spans is None or not len(spans):
        return 0, 0, body
    change = np.zeros(len(body) + 1, np.int64)
    for s in spans:
        change[s["start"]] += 1
        change[s["end"]] -= 1
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, crowded: int = CROWDED) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): kept has the bytes of each document that stay.

    Strings are compared by hashes: 48 bits of an anchor's together with 56 of all around it, or with 64 of the window.
    Among N anchors about N * N / 2 ** 105 pairs, under one in a million for 10 ** 12, are taken as equal and aren't.
    Defined cases: a null text counts as empty; a text of fewer than 100 bytes has nothing to remove; rows that repeat
    a document's id and text are that document, and get the same result each; rows of one id with different texts are
    documents of their own, in the order of a hash of their texts; null ids come last; ids may be of any type that has
    an order; other columns are ignored; an empty table gives no row.
    """
    body, size = keyed(docs, doc_id, text)
    kind = body.schema["own"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            bodies = [unpress.decompress(b, max_output_size=1 << 31) for b in batch["body"]]
            kept = [_without(b, s) for b, s in zip(bodies, batch["spans"])]
            yield pd.DataFrame({doc_id: batch["own"], "n_bytes": [len(b) for b in bodies], "n_removed": [k[0] for k in kept], "n_spans": [k[1] for k in kept], "kept": [k[2] for k in kept]})

    joined = _packed(body).join(repeated_spans(body.select("id", "text"), size, hot, crowded), "id", "left")
    return joined.mapInPandas(cut, f"`{doc_id}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
