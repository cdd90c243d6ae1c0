import itertools
import random
from zlib import crc32

import numpy as np

from larkspan.llm import quality, toxicity
from tests.llm.conftest import prose


def labelled(spark, documents):
    pick, rows, labels = random.Random(6), [], []
    for i in range(500):
        text, good, toxic = prose(80, 70_000 + i), 1, 0
        if i % 4 == 0:
            good, text = 0, (text.upper().replace(" ", "!! ") if i % 8 else " | ".join(text.split()))
        if i % 5 == 0:
            toxic, words = 1, text.split()
            words[pick.randrange(len(words))] = pick.choice(("grobian", "grobianus", "snollygost"))
            text = " ".join(words)
        rows.append((10_000 + i, text))
        labels.append((10_000 + i, good, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    return docs, spark.createDataFrame(labels + [(90, None, None), (77_777, 1, 1)], "doc_id long, quality int, toxic int")


def held_out_accuracy(scored, labels, label, parts, fold, threshold):
    rows = scored.join(labels.where(f"{label} IS NOT NULL"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % parts == fold)
    test = [r for r in rows if r["held_out"]]
    return np.mean([(r["score"] >= threshold) == bool(r[label]) for r in test])


def test_quality(spark, documents):
    docs, labels = labelled(spark, documents)
    scored = quality.score_quality(docs, labels)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert held_out_accuracy(scored, labels, "quality", 4, 2, 0.7) >= 0.95


def test_toxicity(spark, documents):
    docs, labels = labelled(spark, documents)
    scored = toxicity.score_toxicity(docs, labels)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert held_out_accuracy(scored, labels, "toxic", 5, 0, 0.5) >= 0.95
    kept = toxicity.drop_toxic(documents, labels)
    assert kept.columns == documents.columns and kept.count() == documents.count()


def test_without_labels_or_rows(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(documents, none).collect()} == {0.5}
    assert toxicity.score_toxicity(documents, none).where("score >= 0.5").count() == 0
    assert quality.score_quality(nothing, none).count() == 0 and toxicity.score_toxicity(nothing, none).count() == 0


def test_grammar_weighs_context():
    lexicon = toxicity.Lexicon({"=fool": 4.0, "^grob": 4.6})
    score = lexicon.score
    toxic = ("a fool here", "he is a grobian", "you are a fool", "a grobian like you", "I will kill you", "ich werde dich umbringen", "not now or here, you fool", "l'fool")
    clean = ("he is not a grobian", "he said grobian", "they aren't a grobian", "you aren’t a fool", "he said you are a fool", "you fool, he said", "kill the lights",
             "I will not kill you", "he said he would kill you", "you and I went far away to kill time", "foolish", "", "n'est grobian")
    assert all(score(t) >= 0.5 for t in toxic) and all(score(t) < 0.5 for t in clean)
    assert score("not a fool but a fool and a fool") >= 0.5 and score("he said fool. fool") >= 0.5 and score("not a fool, not a grobian, not a fool") < 0.5
    assert score("a fool") < score("you, a fool") and score("not a fool") < score("he said fool") < score("a fool")
    assert lexicon.clauses("grobian and fool. nothing. A FOOL!") and not lexicon.clauses("foolish")
    assert len(lexicon.clauses("fool. fool; fool\nfool")) == 4


def evidence_by_rules(symbols, weights):
    """The grammar's rules, each looked up in the whole clause."""
    total, kinds = 0.0, list(symbols)
    for i, s in enumerate(symbols):
        if s in "IH" and any(symbols[j] == "N" for j in range(max(0, i - toxicity.NEGATED_WORDS), i)):
            kinds[i] = "d"
    plain = [i for i, k in enumerate(kinds) if k == "I"]
    for i, s in enumerate(symbols):
        if kinds[i] in "IHd" and "R" in symbols[:i]:
            kinds[i] = "q"
    first = symbols.find("R")
    if first > 0 and any(i < first for i in plain):
        total += toxicity.REPORTED_AFTER
    for k, w in zip(kinds, weights):
        total += w * {"d": toxicity.DENIED_SHARE, "q": toxicity.QUOTED_SHARE}.get(k, 1.0)
    if "I" in kinds and "Y" in kinds:
        total += toxicity.TARGETED
    seen, at = "", 0
    for i, k in enumerate(kinds):
        if seen and i - at > toxicity.THREAT_WORDS:
            seen = ""
        if k in "HY":
            if seen and seen != k:
                total, seen = total + toxicity.THREATENED, ""
            else:
                seen, at = k, i
    return total


def test_composed_grammar_matches_its_rules_on_all_short_clauses():
    own = {"I": 2.5, "H": toxicity.HARM_WEIGHT}
    clauses = ["".join(c) for n in range(6) for c in itertools.product("IHYNRO", repeat=n)]
    pick = random.Random(4)
    clauses += ["".join(pick.choices("IHYNRO", (2, 2, 2, 1, 1, 6), k=pick.randrange(6, 16))) for _ in range(4000)]
    for clause in clauses:
        weights = [own.get(s, 0.0) for s in clause]
        assert abs(toxicity.GRAMMAR.evidence(clause, weights) - evidence_by_rules(clause, weights)) < 1e-9, clause


def test_discriminant_against_its_formula():
    """Log densities from determinants and inverses of the shrunk covariances, not from their factors."""
    pick = np.random.default_rng(0)
    x = {0: pick.normal(0, 1, (400, 3)), 1: pick.normal(1, 2, (600, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]])}
    moments = {c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}
    model = quality.Discriminant(moments, shrink=0.15, ridge=1e-3)
    own = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = 0.4 * own[0] + 0.6 * own[1]
    both = np.concatenate([x[0], x[1]])
    density = []
    for c, share in ((0, 0.4), (1, 0.6)):
        cov = 0.85 * own[c] + 0.15 * (pooled + np.diag(np.diag(pooled)) + 1e-3 * np.eye(3)) / 2 + 1e-3 * np.eye(3)
        off = both - x[c].mean(0)
        density.append(np.log(share) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off))
    assert np.allclose(model.score(both), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-9)


def test_last_words_of_a_text_count_in_every_block_statistic():
    words = prose(60, 3).split()
    names = quality.FEATURES
    for n in (41, 50, 60, 99):
        plain = (words + words)[:n]
        for junk, touched in (("JUNK JUNK JUNK", ("upper", "again")), ("a$ b$ c$", ("marks",)), ("| | |", ("bars", "again"))):
            before, after = (dict(zip(names, quality.text_statistics(" ".join(w)))) for w in (plain, plain[:-3] + junk.split()))
            for name in touched:
                assert after[name] > before[name] and after[f"worst_{name}"] > before[f"worst_{name}"]
