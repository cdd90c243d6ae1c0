import hashlib
import re

from larkspan.llm import exact


def test_groups_match_brute_force(documents, corpus):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in corpus.items()}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    wanted = {i: (min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items() if len(groups[t]) > 1}
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact.copy_groups(documents).collect()}
    assert found == wanted


def test_drop_keeps_columns_and_the_smallest_id(documents, corpus):
    kept = exact.drop_copies(documents)
    assert kept.columns == documents.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert 0 in ids and 60 not in ids and 93 in ids and 94 not in ids and 90 in ids and 99 not in ids


def test_empty_table_and_repeated_rows(nothing, documents):
    assert exact.copy_groups(nothing).count() == 0
    twice = documents.where("doc_id = 5").unionByName(documents.where("doc_id = 5"))
    assert [tuple(r)[2:] for r in exact.copy_groups(twice).collect()] == [(5, 2)]
    assert exact.drop_copies(twice).count() == 2


def test_ids_that_repeat_or_are_null(spark):
    rows = [(1, "A"), (5, "A"), (5, "B"), (None, "A"), (None, "C"), (None, None), (7, ""), (8, "D  x"), (9, "D x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in exact.drop_copies(docs).collect()}
    assert kept == {(1, "A"), (5, "B"), (None, "C"), (7, ""), (8, "D  x")}


def test_white_space_is_normalised_as_asked(spark):
    texts = ["a b", "a  b", "a\tb", "a \n\x0b\x0c\r b", "a b", " a b ", "\n", "", "a\x0eb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(exact.normalised()).collect()]
    assert got == [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts]


def test_the_query_reads_texts_twice_and_shuffles_none(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    out = exact.op7_exact_dedup(spark, str(tmp_path))
    assert out.count() == documents.count()
    alone = out.where("group_size = 1")
    assert alone.where("NOT kept OR keep_id <> doc_id").count() == 0 and alone.count() > 50
