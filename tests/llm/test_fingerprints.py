import hashlib
import random
import re

from pyspark.sql import functions as F

from larkspan.llm import fingerprints as fp

BOUND, LEAST = fp.bound(), fp.LEAST


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def sketch(text):
    hashes = sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles(text)})
    below = [h for h in hashes if h < BOUND]
    return below if len(below) >= LEAST else hashes[:LEAST]


def edited(corpus):
    """By id: the edited text and the next id, by the contract's words."""
    order = sorted(corpus, reverse=True)
    out = {}
    for i, k in zip(order, order[1:] + order[:1]):
        text, other = corpus[i] or "", corpus[k] or ""
        third = len(text) // 3
        out[i] = (text[: len(text) - third] + other[:third], k)
    return out


def test_sketches_match_brute_force(documents, corpus):
    found = {r["doc_id"]: r["sketch"] for r in fp.fingerprints(documents).collect()}
    assert found == {i: sketch(t) for i, t in corpus.items()}
    assert len(found[96]) > LEAST and found[90] == found[91] == found[92] == []


def test_the_query_matches_brute_force(spark, documents, corpus, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = edited(corpus)
    rows = fp.op11_fingerprints(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(corpus)
    for r in rows:
        text, following = wanted[r["doc_id"]]
        assert r["n_chars"] == len(corpus[r["doc_id"]] or "")
        assert r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["fingerprint"] == "".join(sketch(corpus[r["doc_id"]])) and r["edited_fingerprint"] == "".join(sketch(text))
        a, b, c = shingles(corpus[r["doc_id"]]), shingles(text), shingles(corpus[following])
        for near, other in ((r["near_edited"], b), (r["near_next"], c)):
            if len(a) < LEAST and len(other) < LEAST:  # sketches of everything
                assert near == (len(a & other) / len(a | other) if a | other else 1.0)
            else:
                assert abs(near - len(a & other) / len(a | other)) < 0.25
    long = [r for r in rows if r["n_chars"] > 300]
    assert all(r["near_edited"] > r["near_next"] for r in long if not set(sketch(corpus[wanted[r["doc_id"]][1]])) & set(sketch(corpus[r["doc_id"]])))


def test_a_merged_sketch_is_the_sketch_of_the_union(spark):
    pick = random.Random(3)
    pools = [[f"w{pick.randrange(10**6)}" for _ in range(n)] for n in (0, 3, 20, 40, 300, 2000)]
    texts = [" ".join(p) for p in pools]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fp.merge(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("m")).collect()
    for r in got:
        both = sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles(r["a"]) | shingles(r["b"])})
        below = [h for h in both if h < BOUND]
        assert r["m"] == (below if len(below) >= LEAST else both[:LEAST])


def test_containment_of_a_short_text_in_a_long_one(spark):
    pick = random.Random(4)
    long = [f"w{pick.randrange(10**6)}" for _ in range(20_000)]
    part, half = long[5000:7000], long[:1000] + [f"x{i}" for i in range(1000)]
    docs = spark.createDataFrame([("a", 1, " ".join(part)), ("a", 2, " ".join(half)), ("b", 3, " ".join(long)), ("c", 4, None)], "g string, doc_id long, text string")
    made = docs.join(fp.fingerprints(docs), "doc_id")
    both = made.alias("x").crossJoin(made.where("g = 'b'").alias("y")).select("x.doc_id", fp.estimates(F.col("x.sketch"), F.col("y.sketch")).alias("e"))
    held = {r["doc_id"]: r["e"]["held"] for r in both.collect()}
    assert held[1] == 1.0 and abs(held[2] - 0.5) < 0.1 and held[3] == 1.0 and held[4] == 0.0
    groups = fp.group_sketches(made, "g")
    found = {(r["g"], r["other"]): r["held"] for r in fp.contained(groups.where("g = 'a'"), groups.where("g = 'b'"), "g").collect()}
    assert set(found) == {("a", "b")} and abs(found["a", "b"] - 0.75) < 0.06


def test_next_in_any_order_of_ids(spark):
    pick = random.Random(5)
    ids = pick.sample(range(-(10**12), 10**12), 500) + [-(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string").repartition(7)
    got = {r["id"]: (r["next"]["id"], r["next"]["t"]) for r in fp.with_next(rows, "id").collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: (k, f"t{k}") for i, k in zip(order, order[1:] + order[:1])}


def test_null_ids_repeated_rows_and_empty_tables(spark, nothing):
    rows = [(None, "b"), (None, "a"), (2, "x"), (2, "x"), (2, "y"), (9, None)]
    got = sorted((r["id"] or 0, r["t"] or "", r["next"]["id"] or 0, r["next"]["t"] or "") for r in fp.with_next(spark.createDataFrame(rows, "id long, t string"), "id").collect())
    assert got == [(0, "a", 9, ""), (0, "b", 0, "a"), (2, "x", 0, "b"), (2, "x", 2, "x"), (2, "y", 2, "x"), (9, "", 2, "y")]
    only = fp.with_next(spark.createDataFrame([(None, "b")], "id long, t string"), "id").collect()
    assert [(r["t"], r["next"]["t"]) for r in only] == [("b", "b")]
    assert fp.fingerprints(nothing).count() == 0 and fp.edited_pairs(nothing).count() == 0


def test_no_python_worker_and_one_shuffle_of_texts(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    plan = fp.op11_fingerprints(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1
