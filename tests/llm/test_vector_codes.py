import hashlib
import math
import random

import numpy as np
import pytest

from larkspan.llm import vector_codes as vc


def brute_force(rows, rounds=6):
    """By id: (code, error); the codebooks. From the contract's words, in Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort()
    d = len(kept[0][1]) // 8
    parts = {i: [v[p * d : p * d + d] for p in range(8)] for i, v in kept}
    books = [[parts[i][p] for i, _ in kept[:16]] for p in range(8)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            own = {}
            for i, _ in kept:
                own.setdefault(nearest(parts[i][p], p)[1], []).append(parts[i][p])
            for e, members in own.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    final = {i: [nearest(parts[i][p], p) for p in range(8)] for i, _ in kept}
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(s for s, _ in f)) for i, f in final.items()}, books


def vectors(n, seed, d=64, spread=0.3):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(d)] for _ in range(9)]
    out = []
    for i in range(n):
        c = pick.choice(centres)
        out.append((i * 3 + 1, [float(np.float32(x + pick.gauss(0, spread))) for x in c]))
    return out


def table(spark, rows, labels=lambda i: i % 4):
    return spark.createDataFrame([(i, v, labels(i or 0), "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, id string, code int").repartition(5)


def test_the_query_matches_brute_force(spark, tmp_path):
    rows = vectors(300, 1) + vectors(30, 2, spread=4.0)
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    bad = [(1000, None), (1001, [1.0] * 63 + [None]), (1002, [float("nan")] * 64), (1003, [float("inf")] + [0.0] * 63), (1004, [])]
    table(spark, rows + bad, lambda i: None if i % 5 == 0 else i % 4).write.parquet(str(tmp_path / "embeddings.parquet"))
    wanted, books = brute_force(rows)
    out = vc.op13_vector_codes(spark, str(tmp_path)).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in out} == wanted
    sums = {}
    for i, (_, error) in wanted.items():
        label = None if i % 5 == 0 else i % 4
        sums[label] = sums.get(label, 0) + error
    assert {r["vec_id"]: r["label_error"] for r in out} == {i: sums[None if i % 5 == 0 else i % 4] for i in wanted}
    text = ",".join(str(x) for p in books for e in p for x in e)
    assert {r["codebooks_sha256"] for r in out} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("scale", [0.002, 1.0, 300.0])
def test_bounds_give_the_nearest_entry_after_every_move(scale):
    pick = np.random.default_rng(3)
    x = vc.integers(pick.normal(0, scale, (400, 64)).astype(np.float32))
    books = x[:16].transpose(1, 0, 2).copy()
    x = np.concatenate([x, books.transpose(1, 0, 2), (books.transpose(1, 0, 2) + books.transpose(1, 0, 2)[::-1]) // 2])
    state, part, skipped = vc.fresh(x, books, 4), np.tile(np.arange(8), len(x)), 0
    for turn, b in enumerate((4, 4, 3, 3, 2, 2)):
        new = books + pick.integers(-9, 10, books.shape) * (turn % 3)
        new[:, 5] = new[:, 9]  # a tie of two entries
        moves = vc._above(((new - books) ** 2).sum(2))
        state, levels = vc.advance(x, state, new, moves, b)
        books, skipped = new, skipped + levels[0]
        squares = vc._squares(x.reshape(-1, 8), books, part, np.tile(np.arange(16), (len(part), 1)))
        assert (state.near[:, :, 0].ravel() == squares.argmin(1)).all()
        own = np.sqrt(squares.min(1))
        assert (state.high.ravel() >= own).all() and state.near.shape[2] == b + 1 and levels.sum() == len(part)
        near, low = state.near.reshape(len(part), -1), state.low.reshape(len(part), -1)
        for z in range(1, b + 1):
            assert (low[:, z - 1] <= np.sqrt(np.take_along_axis(squares, near[:, z : z + 1].astype(int), 1))[:, 0]).all()
        others = squares.astype(float)
        np.put_along_axis(others, near.astype(int), np.inf, 1)
        assert (low[:, b] <= np.sqrt(others.min(1))).all()
    assert skipped > 400


def test_few_vectors_ties_repeats_and_other_lengths(spark):
    same = [0.25] * 16
    rows = [(5, same), (5, same), (6, [0.5] * 16), (None, same), (7, [1.0] * 24)]
    out, books = vc.encode(table(spark, rows))
    found = sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in out.collect())
    assert found == [(0, "00" * 8, 0), (5, "00" * 8, 0), (5, "00" * 8, 0), (6, "02" * 8, 0)] and books.shape == (8, 4, 2)
    one, books = vc.encode(table(spark, [(1, same)]))
    assert [r["code"] for r in one.collect()] == ["00" * 8] and books.shape == (8, 1, 2)
    out, books = vc.encode(table(spark, [(i, [float(i), 1e30, -1e30]) for i in range(20)]))
    assert out.count() == 20 and books.max() == vc.LARGEST


def test_an_empty_table_and_rounds(spark):
    rows = vectors(40, 4, d=16)
    nothing, books = vc.encode(table(spark, rows).limit(0))
    assert nothing.count() == 0 and books.size == 0 and nothing.columns == ["vec_id", "label", "code", "error"]
    for rounds in (0, 1, 3):
        out, books = vc.encode(table(spark, rows), rounds=rounds)
        wanted, expected = brute_force(rows, rounds)
        assert {r["vec_id"]: (r["code"], r["error"]) for r in out.collect()} == wanted and books.tolist() == expected
