"""Vectors as codes of eight parts: a codebook for each part, refined in rounds that distance bounds keep cheap."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import forget, stored, with_group

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components beyond so much count as it, so that all distances are exact 64-bit integers.
LARGEST = 1 << 26
#: Of the parts that need distances, this share shall be settled by the closest entries that are kept.
SETTLED = 0.99


@dataclass
class State:
    """The bounds of ``n`` vectors, for each part of each: ``near`` (n, PARTS, 1 + b) are the entry it has and its b
    closest others, ``low`` (n, PARTS, b + 1) lower bounds of the distances to these in ascending order and, last, to
    all others, ``high`` (n, PARTS) an upper bound of the distance to its own."""

    near: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _above(squares: np.ndarray) -> np.ndarray:
    """Square roots of integers, rounded up to a 32-bit float."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _below(squares: np.ndarray) -> np.ndarray:
    """Square roots of integers, rounded down to a 32-bit float, 0 at least."""
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squares(x: np.ndarray, books: np.ndarray, part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of parts ``x`` (m, d) to some ``entries`` (m, k) of their position's codebook."""
    out = np.zeros(entries.shape, np.int64)
    for j in range(x.shape[1]):
        step = x[:, j, None] - books[:, :, j][part[:, None], entries]
        out += step * step
    return out


def _full(x: np.ndarray, books: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries in order of distance, ties to the lower index, and their squared distances."""
    every = np.broadcast_to(np.arange(books.shape[1]), (len(x), books.shape[1]))
    squares = _squares(x, books, part, every)
    order = np.argsort(squares, axis=1, kind="stable")
    return order, np.take_along_axis(squares, order, 1)


def _closest(x: np.ndarray, books: np.ndarray, part: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own and b closest entries, lower bounds and upper bound of parts ``x`` (m, d), from all distances."""
    order, squares = _full(x, books, part)
    low = _below(squares[:, 1 : b + 2])
    if low.shape[1] == b:  # all others are kept
        low = np.concatenate([low, np.full((len(low), 1), np.float32(np.inf))], 1)
    return order[:, : b + 1].astype(np.uint8), low, _above(squares[:, 0])


def fresh(x: np.ndarray, books: np.ndarray, b: int) -> State:
    """The state of vectors ``x`` (n, PARTS, d) with b kept entries, fewer than there are."""
    n, parts, d = x.shape
    near, low, high = _closest(x.reshape(-1, d), books, np.tile(np.arange(parts), n), b)
    return State(near.reshape(n, parts, -1), low.reshape(n, parts, -1), high.reshape(n, parts))


def advance(x: np.ndarray, state: State, books: np.ndarray, moved: np.ndarray, b: int) -> tuple[State, np.ndarray]:
    """The state after the codebooks have moved to ``books``, each entry by at most ``moved`` (PARTS, entries), and how
    many parts were settled at each level.

    Bounds follow the moves by the triangle inequality: the upper one grows, those of kept entries shrink by the
    entry's own move, the outer one by the greatest of all. A part whose upper bound is strictly below the first lower
    bound keeps its entry without a distance. Otherwise it is settled at the first level z whose bound for all that
    comes later is above the upper bound: integer distances to its own entry and the z closest others decide, ties to
    the lower index. Where no level is, all distances are computed and the kept entries chosen anew."""
    n, parts, d = x.shape
    x = x.reshape(-1, d)
    part = np.tile(np.arange(parts), n)
    near, low, high = state.near.reshape(n * parts, -1), state.low.reshape(n * parts, -1), state.high.reshape(-1)
    if b < near.shape[1] - 1:  # fewer are kept from now on: the others join the outer bound, which is the least of theirs
        near, low = near[:, : b + 1], np.concatenate([low[:, :b], low[:, b:].min(1, keepdims=True)], 1)
    b = near.shape[1] - 1
    up = np.float32(np.inf)
    high = np.nextafter(high + moved[part, near[:, 0]], up)
    low = np.nextafter(low - np.concatenate([moved[part[:, None], near[:, 1:]], moved.max(1)[part][:, None]], 1), -up)
    low = np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1]
    # level z: what comes after the z closest is farther than the own entry
    sure = high[:, None] < low
    level = np.where(sure.any(1), sure.argmax(1), b + 1)
    near, low = near.copy(), low.copy()
    for z in range(1, b + 1):
        at = np.flatnonzero(level == z)
        if len(at):
            tried = near[at, : z + 1]
            squares = _squares(x[at], books, part[at], tried)
            order = np.lexsort((tried, squares), axis=1)
            tried, squares = np.take_along_axis(tried, order, 1), np.take_along_axis(squares, order, 1)
            near[at, : z + 1], high[at], low[at, :z] = tried, _above(squares[:, 0]), _below(squares[:, 1:])
    at = np.flatnonzero(level == b + 1)
    if len(at):
        near[at], low[at], high[at] = _closest(x[at], books, part[at], b)
    # a bound of all that comes later holds for each before it
    low = np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1]
    shape = (n, parts)
    return State(near.reshape(*shape, -1), low.reshape(*shape, -1), high.reshape(shape)), np.bincount(level, minlength=ENTRIES + 1)


def integers(vectors: np.ndarray) -> np.ndarray:
    """Components as integers, rounded down, in PARTS parts; zeros fill the last part up, which changes no distance."""
    x = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS))).reshape(len(x), PARTS, -1)


def sums(x: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """For each part and entry the number of its parts and their sums, component by component."""
    out = np.zeros((PARTS, entries, 1 + x.shape[2]), np.int64)
    for p in range(PARTS):
        out[p, :, 0] = np.bincount(own[:, p], minlength=entries)
        for j in range(x.shape[2]):
            # exact: below 2 ** 53 in a batch
            out[p, :, 1 + j] = np.bincount(own[:, p], x[:, p, j].astype(np.float64), minlength=entries)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.py_buffer(flat)])


def _rows(column: pa.Array, dtype: type, *shape: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), *shape)


def _state_batch(batch: pa.RecordBatch, x: np.ndarray, state: State, told: np.ndarray) -> pa.RecordBatch:
    numbers = pa.array([told.tolist()] + [None] * (len(x) - 1), pa.list_(pa.int64()))
    columns = [batch.column("id"), batch.column("label"), _binary(x.astype(np.int32)), _binary(state.near), _binary(state.low), _binary(state.high), numbers]
    return pa.RecordBatch.from_arrays(columns, ["id", "label", "x", "near", "low", "high", "numbers"])


def _state_of(batch: pa.RecordBatch, width: int, b: int) -> tuple[np.ndarray, State]:
    x = _rows(batch.column("x"), np.int32, PARTS, width).astype(np.int64)
    near, low = _rows(batch.column("near"), np.uint8, PARTS, 1 + b), _rows(batch.column("low"), np.float32, PARTS, 1 + b)
    return x, State(near, low, _rows(batch.column("high"), np.float32, PARTS))


def _over(df: DataFrame, schema: str, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield change(batch)

    return df.mapInArrow(run, schema)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` without the rows whose vector is null or empty or holds null or non-finite components."""
    whole = F.forall(F.col(f"`{vector}`"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(F.size(F.col(f"`{vector}`")) > 0, F.lit(False)) & whole)


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) of all usable vectors, and the codebooks (PARTS, entries, components).

    A round reads the state table of the one before, moves each part's bounds, computes integer distances only where
    these leave the entry open, and writes the new state; the sums for the next codebooks come in a few rows of it.
    What is kept of each part's closest entries starts at a quarter of them and goes down to an eighth, as far as SETTLED
    of the open cases allow. The driver sees codebooks, sums and the first ENTRIES vectors alone.

    Defined cases: vectors that aren't usable have no row, nor have those of another length than the usable one with
    the smallest id; with fewer usable vectors than ENTRIES the codebooks are smaller; a null id comes after all
    others, rows that share an id go by their components; equal vectors have equal codes; components are held to
    +-16384, so that sums of squares are exact; other columns are ignored; an empty table gives no row."""
    named = usable(vectors, vector).select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    id_type, label_type = (named.schema[c].dataType.simpleString() for c in ("id", "label"))
    first = named.orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    if not first:
        return named.select(F.col("id").alias(vec_id), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    length = len(first[0]["v"])
    named = named.where(F.size("v") == length)
    smallest = named.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").collect()
    books = integers(np.array([r["v"] for r in smallest])).transpose(1, 0, 2)
    entries, width = books.shape[1:]
    b = min(ENTRIES // 4, entries - 1)
    schema = f"id {id_type}, label {label_type}, x binary, near binary, low binary, high binary, numbers array<bigint>"
    levels = ENTRIES + 1

    def begin(batch: pa.RecordBatch, books=books, b=b) -> pa.RecordBatch:
        x = integers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length))
        state = fresh(x, books, b)
        return _state_batch(batch, x, state, np.concatenate([np.zeros(levels, np.int64), sums(x, state.near[:, :, 0], entries).ravel()]))

    table = stored(_over(named, schema, begin), "codes-state")
    for turn in range(rounds):
        spread = table.where("numbers IS NOT NULL").select(F.posexplode("numbers").alias("at", "n"))
        told = np.zeros(levels + PARTS * entries * (1 + width), np.int64)
        for r in spread.groupBy("at").agg(F.sum("n").alias("n")).collect():
            told[r["at"]] = r["n"]
        open_parts, totals = told[1:levels], told[levels:].reshape(PARTS, entries, 1 + width)
        used = totals[:, :, :1]
        moved_to = np.where(used > 0, totals[:, :, 1:] // np.maximum(used, 1), books)
        moves = _above(((moved_to - books) ** 2).sum(2))
        moves[(moved_to == books).all(2)] = 0
        within, kept = np.cumsum(open_parts[:b]), b
        if b and within[-1]:
            kept = min(b, max(int(np.searchsorted(within, SETTLED * within[-1])) + 1, ENTRIES // 8))
        books = moved_to
        if turn == rounds - 1:
            break

        def go_on(batch: pa.RecordBatch, books=books, moves=moves, had=b, b=kept) -> pa.RecordBatch:
            x, state = _state_of(batch, width, had)
            state, settled = advance(x, state, books, moves, b)
            return _state_batch(batch, x, state, np.concatenate([settled, sums(x, state.near[:, :, 0], entries).ravel()]))

        before, table, b = table, stored(_over(table.drop("numbers"), schema, go_on), "codes-state"), kept
        forget(before)

    def end(batch: pa.RecordBatch, books=books, moves=moves if rounds else None, had=b, b=kept if rounds else b) -> pa.RecordBatch:
        x, state = _state_of(batch, width, had)
        if moves is not None:
            state, _ = advance(x, state, books, moves, b)
        own = state.near[:, :, 0]
        part = np.tile(np.arange(PARTS), len(x))
        error = _squares(x.reshape(-1, width), books, part, own.reshape(-1, 1)).reshape(len(x), PARTS).sum(1)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _binary(own), pa.array(error)], ["id", "label", "code", "error"])

    done = stored(_over(table.drop("numbers"), f"id {id_type}, label {label_type}, code binary, error long", end), "codes")
    forget(table)
    return done.select(F.col("id").alias(vec_id), "label", F.lower(F.hex("code")).alias("code"), "error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    named = found.withColumn("label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    groups = named.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("group_size"))
    rows = with_group(named, stored(groups, "codes-labels"), "label", "group_size")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """The rounds as one chain of tables: c<r> the codebooks, a<r> each part's nearest entry."""
    d = 64 // PARTS
    xs = [f"x{j}" for j in range(d)]
    square = " + ".join(f"(v.{x} - c.{x}) * (v.{x} - c.{x})" for x in xs)
    out = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
), v AS MATERIALIZED (
  SELECT vec_id, label, p, {', '.join(f'x[{d} * p + {j + 1}] AS {x}' for j, x in enumerate(xs))} FROM kept, range({PARTS}) r(p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {', '.join(xs)} FROM v QUALIFY e < {ENTRIES}
)"""]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.p, min({{'d': {square}, 'e': c.e}}) AS b FROM v JOIN c{r} c ON c.p = v.p GROUP BY vec_id, v.p)")
        if r < ROUNDS:
            means = ", ".join(f"floor(sum({x})::DOUBLE / count(*))::BIGINT AS {x}" for x in xs)
            moved = f"SELECT p, b.e AS e, {means} FROM a{r} JOIN v USING (vec_id, p) GROUP BY p, b.e"
            either = ", ".join(f"coalesce(m.{x}, c.{x}) AS {x}" for x in xs)
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, {either} FROM c{r} c LEFT JOIN ({moved}) m ON m.p = c.p AND m.e = c.e)")
    numbers = " || ',' || ".join(xs)
    return f"""WITH {', '.join(out)}, code AS (
  SELECT vec_id, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg({numbers}, ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM code JOIN kept USING (vec_id), digest
"""


OP13_SQL = _op13_sql()
