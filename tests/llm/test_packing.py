import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import packing


def test_round_trip(documents, corpus):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary())
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in corpus.items()}
    rows = packing.pack(documents).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for whole in (*pieces.values(), *sequences.values()):
        at = 0
        for start, length in sorted(whole):
            assert start == at
            at += length
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    assert max(sum(n for _, n in s) for s in sequences.values()) <= 1024
    total = sum(len(x) for x in ids.values())
    assert len(sequences) <= total // 1024 + 2


def test_special_strings_and_other_scripts_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary())
    texts = ["a<|endoftext|>b", "漢字 and кириллица", "tab\tand\x85next\u2028line", "É ß ñ", "x" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(frame).collect()}
    assert found == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_every_common_character_has_the_tokenizers_ids():
    """All that COMMON admits, each alone and beside letters, marks, figures, white space and others of its range."""
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    encode, own = packing._encoder(path), Tokenizer.from_file(path)
    admitted = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)] if packing.COMMON.fullmatch(chr(c))]
    assert len(admitted) > 500
    texts = [f.format(c=c, d=d) for c, d in zip(admitted, admitted[7:] + admitted[:7]) for f in ("{c}", " {c}", "a{c}b", "{c}{c}", "1{c}2", ".{c}!", "\n{c} \n", "'{c}", "{c}{d}", "{d} {c}", "X{c}{d}9 ", "  {c}  {d}")]
    assert [encode(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1))
def test_patterns_hold_every_length(histogram):
    packs = packing.patterns(histogram, 64)
    held = Counter()
    for count, lengths in packs:
        assert sum(lengths) <= 64
        held.update({x: count * n for x, n in Counter(lengths).items()})
    assert held == histogram


def test_little_padding():
    pick = random.Random(0)
    histogram = Counter(pick.randint(1, 1023) for _ in range(20_000))
    total = sum(k * n for k, n in histogram.items())
    assert sum(c for c, _ in packing.patterns(histogram)) * 1024 < 1.005 * total


def test_empty_table(nothing):
    assert packing.pack(nothing).count() == 0
