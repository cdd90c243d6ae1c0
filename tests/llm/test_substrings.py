import random

import numpy as np
import pytest

from larkspan.llm import substrings


def brute(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 99):
            w = b[a : a + 100]
            if w in seen:
                gone[a : a + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def found(frame, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(frame, **options).collect()}


def test_matches_brute_force(documents, corpus):
    wanted = brute(corpus)
    assert sum(w[1] for w in wanted.values()) > 5000
    assert found(documents) == wanted


def test_periodic_and_embedded(spark):
    pick = random.Random(2)
    line = "".join(pick.choice("abcdefgh ") for _ in range(140))
    texts = {i: "".join(pick.choice("xyz ") for _ in range(pick.randrange(80))) + line[pick.randrange(30) :] + "q" * pick.randrange(260) for i in range(40)}
    texts |= {50: "ab" * 500, 51: "ba" * 300, 52: line[:99], 53: line[:100]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(frame) == brute(texts)


def test_hot_anchors_are_dealt_by_window(documents, corpus):
    assert found(documents, hot=1) == brute(corpus)


def test_empty_table_and_repeated_rows(nothing, documents):
    assert substrings.remove_repeats(nothing).count() == 0
    twice = documents.where("doc_id = 96").unionByName(documents.where("doc_id = 96"))
    assert len({(r["n_removed"], bytes(r["kept"])) for r in substrings.remove_repeats(twice).collect()}) == 1


@pytest.mark.parametrize("length", [100, 101, 177, 500])
def test_every_window_has_one_anchor(length):
    body = bytes(random.Random(length).randrange(97, 100) for _ in range(length))
    _, _, position, window, windows = substrings.anchors(body)
    assert windows.sum() == length - 99 and window[0] == 0
    for p, w, n in zip(position, window, windows):
        assert w + n - 1 <= p <= w + substrings.BACK


def test_crowded_anchors_pass_by_any_task(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    assert len(substrings.crowded_ranks(documents.selectExpr("doc_id AS id", "coalesce(text, '') AS text"), 1)) > 50
    assert found(documents, crowded=1) == brute(corpus)
    passage = "one passage that stands in every document, with a hundred bytes and more of the same text all through, " * 2
    texts = {i: f"document {i} begins {i * 7}. {passage} and ends {i * 13} so" for i in range(300)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert len(substrings.crowded_ranks(frame.selectExpr("doc_id AS id", "text"), 100)) >= 2
    assert found(frame, crowded=100) == found(frame) == brute(texts)


def test_ids_that_repeat_or_are_null(spark):
    pick = random.Random(12)
    a, b = ("".join(pick.choice("abcdefgh") for _ in range(n)) for n in (260, 240))
    rows = [(3, a), (3, b), (3, a), (None, b + "x"), (4, a[:150]), (None, None), (5, "")]
    got = sorted(tuple(r)[:3] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] is not None)
    assert [g for g in got if g[0] > 3] == [(4, 150, 150), (5, 0, 0)] and len(got) == 5
    assert len({g for g in got if g[1] == 260}) == 1
    nulls = [tuple(r)[:3] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] is None]
    assert sorted(nulls, key=str) == [(None, 0, 0), (None, 241, 240)] or nulls == [(None, 241, 240), (None, 0, 0)]
    named = spark.createDataFrame([("b", a), ("a", a)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(named).collect()} == {"a": 0, "b": 260}
