import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspan.llm import resampling as rs


def grams(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % rs.BUCKETS


def brute_force(docs, target):
    """By id: (n_features, weight, score, rank), from the contract's words."""
    features = {i: grams(t) for i, t in docs.items()}
    s = Counter(bucket(g) for _, gs in features.values() for g in gs)
    t = Counter(bucket(g) for text in target for g in grams(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + rs.BUCKETS) / ((s[b] + 1) * (all_t + rs.BUCKETS))))
    out, order = {}, []
    for i, (n, gs) in features.items():
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in gs)
        out[i] = (len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        if n >= 20:
            order.append((-out[i][2], i))
    rank = {i: k for k, (_, i) in enumerate(sorted(order)[: 5 * len(order) // 100], 1)}
    return {i: (*o, rank.get(i)) for i, o in out.items()}


def test_crcs_of_grams_come_from_prefixes():
    pick = random.Random(1)
    for sizes in ((1, 2, 5, 9), (127, 128, 129, 300), (1, 5000)):
        words = [bytes(pick.choice(b"abc9\xc3\xa9\xff") for _ in range(pick.choice(sizes))) for _ in range(400)]
        for n, found in enumerate(rs.gram_crcs(words), 1):
            assert found.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    assert [len(c) for c in rs.gram_crcs([b"a", b"b"])] == [2, 1, 0] and [len(c) for c in rs.gram_crcs([])] == [0, 0, 0]


def test_shifts_of_any_length():
    crcs = np.array([zlib.crc32(b"left"), zlib.crc32(b"other")], np.uint32)
    for n in (0, 1, 127, 128, 129, 1000, 70_000):
        zeros = zlib.crc32(bytes(n))
        wanted = [zlib.crc32(b + bytes(n)) ^ zeros for b in (b"left", b"other")]
        assert rs.shifted(crcs, np.array([n, n])).tolist() == wanted


def test_words_are_the_contract_s():
    for text in ("Ab c-d É9_x\x7fΩ~ĀB", "  ", "", "日本 x", "a\x00b", "ab c"):
        assert [w.decode() for w in rs.text_words(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_the_query_matches_brute_force(spark, documents, corpus, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    target = [corpus[3], corpus[84], "some other words of the target", None, ""]
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in rs.op12_importance_resampling(spark, str(tmp_path)).collect()}
    assert found == brute_force(corpus, target) and sum(r[3] is not None for r in found.values()) == 2


def test_blocks_smaller_than_a_text(spark, documents, corpus, monkeypatch):
    wanted = brute_force(corpus, [corpus[3]])
    monkeypatch.setattr(rs, "BLOCK", 500)
    target = documents.where("doc_id = 3")
    gains = rs.bucket_gains(documents, target)
    assert {r["doc_id"]: (r["n_features"], r["weight"]) for r in rs.weigh(documents, gains).collect()} == {i: w[:2] for i, w in wanted.items()}


def test_ranks_with_ties_nulls_and_many_tasks(spark):
    pick = random.Random(2)
    rows = [(i, pick.randrange(40), pick.random() < 0.8) for i in range(3000)] + [(None, 39, True), (9999, 39, None)]
    scored = spark.createDataFrame(rows, "doc_id long, score long, fit boolean").repartition(6)
    for percent in (0, 5, 50, 100):
        found = {r["doc_id"]: r["rank"] for r in rs.ranked(scored, F.col("fit"), percent=percent).collect()}
        order = sorted(((-s, i is None, i or 0, i) for i, s, fit in rows if fit))
        wanted = {k[3]: n for n, k in enumerate(order[: percent * len(order) // 100], 1)}
        assert len(found) == len(rows) and found == {i: wanted.get(i) for i, _, _ in rows}


def test_repeated_rows_null_ids_and_empty_tables(spark, nothing, documents):
    prose = " ".join(f"w{i}" for i in range(30))
    rows = [(1, prose), (1, prose), (None, prose), (None, None), (2, ""), (3, "few words"), *[(i, f"{prose} {i}") for i in range(10, 40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = rs.resample(docs, nothing, percent=50).collect()
    assert len(out) == len(rows) and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 17))
    assert len({r["weight"] for r in out if r["n_words"] == 30}) == 1 and all(r["rank"] is None for r in out if r["n_words"] < 20)
    assert rs.resample(nothing, documents).count() == 0 and rs.feature_counts(nothing).count() == 0


def test_drawn_documents_are_like_the_target(spark):
    pick = random.Random(6)
    kinds = [[f"{k}{i}" for i in range(50)] for k in "ab"]
    rows = [(i, " ".join(pick.choices(kinds[i % 10 == 0], k=40)), "src", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    target = spark.createDataFrame([(" ".join(pick.choices(kinds[1], k=40)),) for _ in range(20)], "text string")
    got = rs.drawn(docs, target)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == 30 and all(i % 10 == 0 for i in ids)
