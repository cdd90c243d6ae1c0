import random

import numpy as np

from larkspan.llm import paragraphs
from tests.llm.conftest import prose


def spans(text):
    p = paragraphs.Paragraphs([text])
    return list(zip(p.start.tolist(), p.length.tolist(), p.words.tolist()))


def brute(texts, least_words=paragraphs.LEAST_WORDS):
    """Clusters by exact Jaccard over all pairs of paragraphs, and the runs that are long enough."""
    units = []
    for i, t in sorted(texts.items()):
        p = paragraphs.Paragraphs([t or ""])
        for k in range(len(p.words)):
            tokens, _ = p.only(np.array([k]))
            units.append((i, k, set(tokens.tolist()), int(p.words[k])))
    label = list(range(len(units)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for n in range(len(units)):
        for m in range(n):
            a, b = units[n][2], units[m][2]
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(n), root(m)))
                label[y] = x
    owners = [set() for _ in units]
    for n in range(len(units)):
        owners[root(n)].add(units[n][0])
    repeated = [n for n in range(len(units)) if len(owners[root(n)]) > 1]
    out, run = {}, []
    for n in [*repeated, None]:
        if run and (n is None or units[n][0] != units[run[-1]][0] or n != run[-1] + 1):
            if sum(units[m][3] for m in run) >= least_words:
                out |= {units[m][:2]: units[root(m)][:2] for m in run}
            run = []
        run.append(n)
    return out


def found(frame, **options):
    rows = paragraphs.repeated_paragraphs(frame, **options).collect()
    assert all(r["removed"] == ((r["doc_id"], r["paragraph"]) != (r["keep_doc_id"], r["keep_paragraph"])) for r in rows)
    return {(r["doc_id"], r["paragraph"]): (r["keep_doc_id"], r["keep_paragraph"]) for r in rows}


def test_matches_brute_force(documents, corpus):
    short = {i: t for i, t in corpus.items() if i not in (95, 96)}
    wanted = brute(short)
    assert len(wanted) > 30 and found(documents.where("doc_id NOT IN (95, 96)")) == wanted


def test_paragraphs_cover_all_words_and_lines():
    for text in (prose(300, 1), "a b\nc", "", "word " * 200, "é ñ " * 50 + "\n\n x. y! z?", " \n "):
        got = spans(text)
        assert sum(w for _, _, w in got) == len(text.split()) and all(w <= paragraphs.WINDOW for _, _, w in got)
        assert [w for s, n, _ in got for w in text[s : s + n].split()] == text.split()
        assert all("\n" not in text[s : s + n] for s, n, _ in got)


def test_a_passage_is_found_wherever_it_stands(spark):
    """With and without ends of sentences, in lines of other text, and of one word or phrase over and over."""
    passages = [prose(52, 7), prose(55, 8).replace(".", ""), "again " * 60, "round and round " * 20, prose(26, 9) + "\n" + prose(27, 10)]
    rows, owners = [], {}
    for n, passage in enumerate(passages):
        for k in range(3):
            i = 10 * n + k
            rows.append((i, f"{prose(11 + 7 * k, 100 + i)} {passage.strip()} {prose(20 - 5 * k, 200 + i)}"))
            owners[i] = n
    rows += [(100 + k, prose(200, 300 + k) + "\nLicensed under the Apache License, Version 2.0, by all of us here.") for k in range(6)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {i for i, _ in got} == set(owners)


def test_families_of_near_copies(spark):
    """More near copies than a crowded key may have; recall against brute force, and no link too many."""
    pick = random.Random(3)
    base = prose(22, 77).replace(".", "").split()
    rows = []
    for i in range(130):
        words = list(base)
        for _ in range(pick.choice((1, 1, 2))):
            words[pick.choice((0, 1, 20, 21))] = f"x{pick.randrange(40)}"
        rows.append((i, " ".join(words)))
    wanted = brute(dict(rows), least_words=20)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), least_words=20)
    assert set(got) <= set(wanted) and len(wanted) > 100 and len(got) >= 0.98 * len(wanted)


def test_one_link_between_crowded_families(spark):
    """Two families share most of their shingles, but of all their pairs just one is similar."""
    rows = []
    for n in range(8):
        base = prose(14, 700 + n).replace(".", "")
        rows += [(100 * n + k, f"left{n}{k // 16} {base} right{n}x{k - k // 16}") for k in range(32)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), least_words=10)
    assert got == {(i, 0): (i // 100 * 100, 0) for i, _ in rows}


def test_links_are_exact_for_every_size(spark):
    """Components of sets of all sizes against exact Jaccard, where most share most of their tokens."""
    pick = random.Random(5)
    pool = [pick.getrandbits(44) for _ in range(15)]
    sets = {frozenset(pick.sample(pool, n)) for n in range(4, 13) for _ in range(70)}
    sets |= {frozenset(pick.getrandbits(44) for _ in range(n)) for n in range(4, 13)}
    tokens = [np.sort(np.array(list(s), np.uint64)) for s in sets]
    sigs = [int(paragraphs.mix(t ^ paragraphs._MUL).sum(dtype=np.uint64).astype(np.int64)) for t in tokens]
    near = {x: {x} | {y for b, y in zip(sets, sigs) if 100 * len(a & b) >= 80 * len(a | b)} for a, x in zip(sets, sigs)}
    for _ in sets:
        near = {x: ys | {z for y in ys for z in near[y]} for x, ys in near.items()}
        if all(near[y] == ys for ys in near.values() for y in ys):
            break
    wanted = {x: min(ys) for x, ys in near.items() if len(ys) > 1}
    table = spark.createDataFrame([(s, bytearray(t.tobytes())) for s, t in zip(sigs, tokens)], "sig long, tokens binary")
    got = {r["node"]: r["label"] for r in paragraphs.components(paragraphs.similar_paragraphs(table)).collect()}
    assert len(set(wanted.values())) > 20 and got == wanted


def test_similar_sets_differ_by_two_shingles_at_most():
    most = paragraphs.WINDOW - paragraphs.WORDS + 1
    ways = {(x, y) for common in range(1, most + 1) for x in range(most - common + 1) for y in range(x + 1) if paragraphs.similar(common, common + x + y)}
    assert ways == {(0, 0), (1, 0), (1, 1), (2, 0)}


def test_one_passage_in_every_document(spark):
    """Its sets, keys and cluster are hot."""
    passage = prose(60, 5)
    rows = [(i, f"{prose(10 + i % 7, 900 + i)}\n{passage}\n{prose(12, 5000 + i)}") for i in range(1500)]
    out = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert out.select("doc_id").distinct().count() == 1500 and out.where("cluster_size = 1500 AND keep_doc_id = 0").count() >= 3 * 1500


def test_ids_that_repeat_or_are_null(spark):
    a, b = prose(50, 1), prose(50, 2)
    rows = [(5, a), (5, b), (None, a), (5, a), (None, b), (None, None), (9, "")]
    out = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {(r["doc_id"], r["removed"]) for r in out.collect()}
    assert kept == {(5, False), (None, True)} and out.where("cluster_size <> 2").count() == 0
    alone = spark.createDataFrame([(1, a), (1, a)], "doc_id long, text string")
    assert paragraphs.repeated_paragraphs(alone).count() == 0


def test_bands_reach_the_recall():
    for rows in (1, 2, 3, 5):
        bands = paragraphs.bands_for(0.8, rows, 0.99)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.99 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_empty_table(nothing):
    assert paragraphs.repeated_paragraphs(nothing).count() == 0


def test_the_query_has_every_repeated_paragraph(spark, tmp_path):
    """A paragraph of 25 words in forty documents, a licence line in three and a word in two."""
    shared = prose(25, 3)
    texts = {i: f"{prose(20, 400 + i)}\n{shared}\n{prose(20, 800 + i)}" for i in range(40)}
    texts |= {50 + k: f"{prose(40, 1200 + k)}\nLicensed under the Apache License, Version 2.0, by all of us here." for k in range(3)}
    texts |= {60: f"Qwerty\n{prose(40, 1300)}", 61: f"{prose(40, 1301)}\nQwerty", 70: prose(60, 1400)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = paragraphs.op10_paragraph_dedup(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["paragraph"]): (r["keep_doc_id"], r["keep_paragraph"]) for r in rows} == brute(texts, least_words=0)
    words = {i: max(r["passage_words"] for r in rows if r["doc_id"] == i) for i in {r["doc_id"] for r in rows}}
    assert {i: words[i] for i in (50, 51, 52, 60, 61)} == {50: 12, 51: 12, 52: 12, 60: 1, 61: 1} and all(words[i] >= 25 for i in range(40)) and 70 not in words
