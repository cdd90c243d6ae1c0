import random
import re

import numpy as np

from larkspan.llm import components, jaccard
from tests.llm.conftest import prose


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_documents(frame).collect()}


def test_matches_brute_force(documents, corpus):
    wanted = brute(corpus)
    assert len({c for _, c in wanted.values()}) < len(wanted) - 12
    assert found(documents) == wanted


def test_large_family_of_near_copies(spark):
    """More copies than make a token frequent, so that sets meet at pairs of tokens."""
    pick = random.Random(4)
    base = [f"w{pick.randrange(10_000)}" for _ in range(150)]
    texts = {}
    for i in range(220):
        words = list(base)
        for _ in range(pick.randrange(5)):
            words[pick.randrange(150)] = f"x{pick.randrange(60)}"
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(frame) == brute(texts)


def test_empty_table_and_repeated_rows(nothing, documents):
    assert jaccard.linked_documents(nothing).count() == 0
    twice = documents.where("doc_id IN (90, 91, 96)").unionByName(documents.where("doc_id IN (90, 96)"))
    rows = [tuple(r) for r in jaccard.linked_documents(twice).orderBy("doc_id").collect()]
    assert [r[0] for r in rows] == [90, 90, 91, 96, 96] and all(r[0] == r[2] for r in rows)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 301), (301, 300)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["label"] for r in components.components(frame).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 150)} == {100} and found[301] == 300
    assert components.components(frame.limit(0)).count() == 0


def test_hot_tokens_travel_apart_with_the_same_links(spark, documents, corpus):
    """One passage in every document, so that its tokens are hot, and near copies among them."""
    passage = prose(40, 1234)
    texts = {i: f"{t} {passage}" for i, t in corpus.items() if t}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    rows = frame.selectExpr("text")
    known, classes = jaccard.hot_tokens(rows, 16)
    assert len(known) >= 30 and len(known) == len(classes) and min(classes) >= 16
    wanted = brute(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_documents(frame, hot=16).collect()} == wanted
    assert found(frame) == wanted


def test_any_list_of_hot_tokens_gives_the_same_links(documents, corpus, monkeypatch):
    """Half of all tokens with classes drawn by lot, so that the estimate is wrong as can be."""
    tokens = np.unique(np.concatenate(list(jaccard.shingle_sets([t or "" for t in corpus.values()]))) >> np.uint64(64 - 8 * jaccard.TOKEN))
    drawn = np.random.default_rng(3)
    known = tokens[drawn.random(len(tokens)) < 0.5]
    classes = drawn.integers(0, 100, len(known)).astype(np.uint8)
    monkeypatch.setattr(jaccard, "hot_tokens", lambda texts, least: (known, classes))
    assert found(documents) == brute(corpus)


def test_ids_that_repeat_or_are_null(spark):
    a, b, c = prose(40, 1), prose(40, 2), prose(40, 3)
    rows = [(1, a), (5, a), (5, b), (None, a + " end"), (None, c), (None, None), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.drop_linked(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (None, c), (None, None), (7, ""), (8, None)], key=str)
