import re

import pytest

from larkspan.llm import decontaminate
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute as brute_links

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies, benchmark passages, nulls, empties, ties and repeats, and columns
    whose names the stages use inside; and the tables beside them."""
    folder = tmp_path_factory.mktemp("tables")
    texts, toxic, items = {}, set(), {k: prose(25, 500 + k) for k in range(4)}
    for i in range(260):
        texts[i] = prose(70, 10_000 + i)
    for i in range(0, 240, 3):
        words = texts[i].split()
        words.insert(30, "snollygost" if i % 2 else "grobian")
        texts[i] = " ".join(words)
        toxic.add(i)
    for i in range(260, 270):
        texts[i] = texts[i - 19].replace(" ", " \t", 3)
    for i in range(270, 280):
        words = prose(100, 20_000 + i // 2).split()
        words[50 + i % 2] = f"changed{i}"
        texts[i] = " ".join(words)
    for i in range(280, 288):
        words = items[i % 4].split()
        words[3] = "other" if i % 2 else words[3]
        texts[i] = f"{prose(30, 30_000 + i)} {' '.join(words)} {prose(20, 31_000 + i)}"
    texts |= {288: None, 289: "", 290: " \n ", 291: prose(9000, 7), 292: "one two", 293: "one two"}
    rows = [(i, t, "en", "src0", len(t or ""), i, 0.5, "s", "h") for i, t in texts.items()]
    rows += [(291, texts[291], "en", "src1", 0, 1, None, None, None), (None, prose(50, 8), None, None, None, None, None, None, None), (250, prose(60, 9), "en", "src1", 0, 1, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, score double, sig string, v string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic, items


def key(r):
    return (r[0], r[1])


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_each_stage_against_brute_force(spark, tables):
    """Every stage on what brute force leaves of the one before."""
    folder, rows, toxic, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    left = [key(r) for r in rows if r[0] not in toxic]
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and rows_of(kept) == sorted(left, key=str)

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t in left:
        first[norm(t)] = min(first.get(norm(t), (1, 0)), (i is None, i or 0))
    left = [(i, t) for i, t in left if (i is None, i or 0) == first[norm(t)]]
    assert len(left) == len({(i, t) for i, t in left}) + 1  # the row that repeats its document stays with it
    kept = stages["exact dedup"](spark, kept, folder)
    assert kept.columns == docs.columns and rows_of(kept) == sorted(left, key=str)

    links = brute_links({n: t for n, (_, t) in enumerate(left)})
    own = lambda n: (left[n][0] is None, left[n][0] or 0)
    least = {}
    for n, (_, root) in links.items():
        least[root] = min(least.get(root, (2, 0)), own(n))
    left = [left[n] for n, (size, root) in links.items() if not size or own(n) == least[root]]
    kept = stages["jaccard join"](spark, kept, folder)
    assert kept.columns == docs.columns and rows_of(kept) == sorted(left, key=str)

    def contaminated(text):
        low = (text or "").translate(decontaminate._LOWER)
        return any(decontaminate.best_match(item.translate(decontaminate._LOWER), low)[0] <= int(0.2 * len(item)) for item in items.values())

    left = [(i, t) for i, t in left if not contaminated(t)]
    kept = stages["decontamination"](spark, kept, folder)
    assert kept.columns == docs.columns and rows_of(kept) == sorted(left, key=str)

    packed = stages["packing"](spark, kept, folder).collect()
    assert sum(r["start"] == 0 for r in packed) == len(left) and sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in whole) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_empty_tables(spark, tables, tmp_path):
    folder = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
