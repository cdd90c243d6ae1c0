import random

import numpy as np
import pytest

from larkspan.llm import decontaminate
from tests.llm.conftest import prose


def test_best_match_against_dynamic_programming():
    pick = random.Random(1)
    for _ in range(60):
        p = "".join(pick.choice("abc") for _ in range(pick.randrange(1, 9)))
        t = "".join(pick.choice("abc") for _ in range(pick.randrange(0, 14)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        distance, start, end = decontaminate.best_match(p, t)
        assert distance == min(row) and row[end] == distance and 0 <= start <= end


def test_finds_exact_and_edited_items(spark, documents):
    items = {k: prose(20 + 3 * k, 700 + k) for k in range(8)} | {8: None, 9: "too short"}
    pick = random.Random(3)
    rows, wanted = [], set()
    for i in range(40):
        text = prose(80, 9000 + i)
        if i < 24:
            words = items[i % 8].split()
            for _ in range(i // 8):
                words[pick.randrange(len(words))] = "other"
            text = f"{text} {' '.join(words)} {prose(30, 9500 + i)}"
            wanted.add((1000 + i, i % 8))
        rows.append((1000 + i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.find_items(docs, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs <= wanted and len(pairs) >= 0.95 * len(wanted)
    texts = dict(rows)
    for r in found:
        if r["distance"] == 0:
            assert texts[r["doc_id"]][r["start"] : r["end"]].lower() == items[r["item_id"]].lower()
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in pairs}


def test_empty_tables(spark, nothing, documents):
    bench = spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string")
    assert decontaminate.find_items(nothing, bench).count() == 0
    assert decontaminate.find_items(documents, bench.limit(0)).count() == 0


def edited(text, share, pick):
    """The text with random characters replaced, left out or put in."""
    out = []
    for c in text:
        kind = pick.choice("rdi") if pick.random() < share else ""
        out.append({"": c, "r": pick.choice("abcdefghij"), "d": "", "i": c + pick.choice("abcdefghij")}[kind])
    return "".join(out)


def test_recall_at_the_least_similarity_against_brute_force(spark):
    pick = random.Random(21)
    items = {k: prose(12 + k, 60_000 + k) for k in range(24)}
    rows, wanted = [], {}
    for i in range(480):
        planted = edited(items[i % 24], (0.1, 0.15, 0.18, 0.2)[i % 4], pick)
        rows.append((i, f"{prose(40, 61_000 + i)} {planted} {prose(30, 62_000 + i)}"))
        distance, _, _ = decontaminate.best_match(items[i % 24].lower(), rows[-1][1].lower())
        if distance <= 0.2 * len(items[i % 24]):
            wanted[i, i % 24] = distance
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(docs, bench).collect()}
    hard = {k for k, d in wanted.items() if d > 0.15 * len(items[k[1]])}
    assert len(hard) > 80 and len(hard & found.keys()) >= 0.9 * len(hard)
    assert len(wanted.keys() & found.keys()) >= 0.95 * len(wanted)
    assert all(found[k] == wanted[k] for k in wanted.keys() & found.keys()) and found.keys() <= wanted.keys()


def test_short_items_are_found_verbatim(spark):
    docs = spark.createDataFrame([(1, "Say FORTY two, please"), (2, "forty twofold"), (3, "xforty two"), (4, "é forty\ttwo"), (5, "forty tw")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "forty two"), (8, " ")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert found == {(1, 7, 4, 13), (4, 7, 2, 11)}


def test_items_without_spaces_are_found_with_edits(spark):
    pick = random.Random(8)
    item = "".join(chr(0x4E00 + pick.randrange(3000)) for _ in range(120))
    planted = list(item)
    for k in pick.sample(range(120), 14):
        planted[k] = "的"
    around = ["".join(chr(0x4E00 + pick.randrange(3000)) for _ in range(200)) for _ in range(2)]
    docs = spark.createDataFrame([(1, around[0] + "".join(planted) + around[1]), (2, around[0] + around[1])], "doc_id long, text string")
    found = decontaminate.find_items(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in found] == [(1, 5, 14)]


def test_repeats_nulls_and_clashing_names(spark):
    item, other = prose(20, 1), prose(400, 2)
    text = f"{prose(30, 3)} {item} {prose(30, 4)} {item} {prose(3, 5)}"
    rows = [(1, text, 0.5), (1, text, 0.5), (1, prose(60, 6), 0.5), (None, text, 0.5), (None, prose(60, 7), None), (2, None, 0.5), (3, "", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, similarity double").withColumnRenamed("similarity", "distance")
    bench = spark.createDataFrame([(7, item, "x"), (8, other, "y"), (9, None, "z")], "item_id long, text string, doc_id string")
    found = decontaminate.find_items(docs, bench).collect()
    assert sorted(str((r["doc_id"], r["item_id"])) for r in found) == sorted(["(1, 7)"] * 4 + ["(None, 7)"] * 2)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]


def replaced(n):
    return lambda text: "".join("q" if i % n == n - 1 and c != "q" else c for i, c in enumerate(text))


def left_out(n):
    return lambda text: "".join(c for i, c in enumerate(text) if i % n != n - 1)


EVEN = {
    "no-break spaces": lambda t: t.replace(" ", " "), "underscores": lambda t: t.replace(" ", "_"), "no spaces": lambda t: t.replace(" ", ""), "two spaces": lambda t: t.replace(" ", "  "),
    "line breaks": lambda t: t.replace(" ", " \n"), **{f"every {n} replaced": replaced(n) for n in (10, 8, 7, 6, 5)}, **{f"every {n} left out": left_out(n) for n in (10, 7, 5)},
    "one a word": lambda t: " ".join(w[: len(w) // 2] + "q" + w[len(w) // 2 + 1 :] for w in t.split()), "words": lambda t: " ".join("other" if i % 6 == 5 else w for i, w in enumerate(t.split())),
}


@pytest.mark.parametrize("n_words", [12, 30])
def test_recall_of_even_edits_against_brute_force(spark, n_words):
    items = {k: prose(n_words, 64_000 + 100 * n_words + k) for k in range(40)}
    rows, wanted, kinds = [], set(), list(EVEN)
    for i, (kind, k) in enumerate((kind, k) for kind in kinds for k in items):
        rows.append((i, f"{prose(40, 65_000 + i)} {EVEN[kind](items[k])} {prose(30, 67_000 + i)}"))
        distance, _, _ = decontaminate.best_match(items[k].translate(decontaminate._LOWER), rows[-1][1].translate(decontaminate._LOWER))
        if distance <= int(0.2 * len(items[k]) + 1e-9):
            wanted.add((i, k))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs.repartition(4), bench).collect()}
    assert found <= wanted
    for n, kind in enumerate(kinds):
        owed = {w for w in wanted if w[0] // 40 == n}
        assert len(owed) > 10 and len(owed & found) >= 0.9 * len(owed), kind


def test_texts_that_repeat_themselves_hold_few_places():
    items = [(0, "ha " * 200), (1, "-" * 60 + " x"), (2, "the end of the day " * 12)]
    seeds = decontaminate.Seeds(items, 0.8)
    for x, text in enumerate(("ha " * 20_000, "-" * 20_000, "the end of the day " * 1000)):
        codes, kept = decontaminate.symbols(text), decontaminate._kept(decontaminate._codes(text))
        for found in (seeds.pairs.found(codes[np.flatnonzero(kept)]), seeds.spaced.found(codes), seeds.plain.found(codes)):
            assert all(len(at) <= decontaminate.HELD + decontaminate.PLACES * len(items) for at, _, _ in found)
        # stretches of half an item, however often both sides repeat themselves
        owner, item, _, _ = seeds.stretches(codes, kept, np.array([0, len(text) + 1]))
        assert set(item.tolist()) == {x} and len(owner) <= 2 + len(text) / (len(items[x][1]) // 2) + decontaminate.PLACES
    text = "ha " * 3000
    found = sorted((a, b) for _, _, a, b, _ in decontaminate.matches(seeds, [text]))
    assert len(found) >= 12 and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))


def test_items_of_signs_and_of_other_scripts():
    pick = random.Random(12)
    signs = "".join(pick.choice("+-*/=<>|&%") for _ in range(90))
    script = " ".join("".join(chr(0x400 + pick.randrange(256)) for _ in range(6)) for _ in range(20))
    seeds = decontaminate.Seeds([(1, signs), (2, script)], 0.8)
    text = f"{prose(20, 1)} {signs[:40]}x{signs[41:]} {prose(20, 2)} {script.replace(' ', '  ', 9)} {prose(9, 3)}"
    assert sorted((x, d) for _, x, _, _, d in decontaminate.matches(seeds, [text])) == [(0, 1), (1, 9)]
