import random

import pytest

WORDS = "the and tion of hand ering onder stile marn velt orris bend quill tave lorn essic umber dray fenn holt".split()


def prose(n, seed):
    pick = random.Random(seed)
    out = []
    for k in range(n):
        word = pick.choice(WORDS) + pick.choice(WORDS)
        out.append(word.capitalize() if k % 9 == 0 else word + "." if k % 9 == 8 else word)
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, by id."""
    pick = random.Random(7)
    texts = {i: prose(pick.choice((3, 12, 60, 150)), i) for i in range(60)}
    for i in range(60, 72):
        texts[i] = texts[i - 60].replace(" ", "  \n ", 1)
    for i in range(72, 84):  # near copies: a word or two changed
        words = prose(150, 1000 + i // 4).split()
        for _ in range(1 + i % 3):
            words[pick.randrange(len(words))] = f"changed{i}"
        texts[i] = " ".join(words)
    passage = prose(70, 99)
    for i in range(84, 90):
        texts[i] = f"{prose(40, 2000 + i)} {passage} {prose(30, 3000 + i)}"
    texts |= {90: None, 91: "", 92: " \t\n ", 93: "one two", 94: "one two", 95: "É" * 300, 96: prose(6000, 5), 97: "ab " * 400, 98: "", 99: None}
    return texts


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names operators use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, "s", 0.5) for i, t in corpus.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, sig string, score double").repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
