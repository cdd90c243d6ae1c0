"""Sets of five-word shingles as sorted 64-bit hashes, made for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
_U = np.uint64
_BASE, _MUL, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at a time.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _MIX1
    x = (x ^ (x >> _U(33))) * _MIX2
    return x ^ (x >> _U(33))


_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 2 * BLOCK)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words (A-Z lower-cased, separated by ASCII white space), the text each is in, and where
    it begins and ends in the texts joined by one byte."""
    buf = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    space = _SPACE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    powers, inverses = power_tables(len(buf) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(buf.astype(_U) * powers[: len(buf)])])
    hashes = mix((total[ends] - total[begins]) * inverses[begins] + (ends - begins).astype(_U))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins, side="right") - 1, begins, ends


def shingle_sets(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; of the whole sequence of words where
    there are fewer; none where there are no words."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        block.append(text.encode("utf-8", "surrogatepass"))
        size += len(block[-1])
        if size >= BLOCK:
            yield from _block_sets(block)
            block, size = [], 0
    if block:
        yield from _block_sets(block)


def _block_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    words, owner, _, _ = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(len(words) - WORDS + 1, 0)
    shingles = np.zeros(n, _U)
    for k in range(WORDS):
        shingles = shingles * _MUL + words[k : n + k]
    shingles = mix(shingles)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            yield np.unique(shingles[a : b - WORDS + 1])
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _MUL + w
            yield mix(np.array([h], _U))
        else:
            yield np.zeros(0, _U)


def signature(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set, as a signed number."""
    return int((mix(shingles ^ _MIX1).sum(dtype=_U) + _U(len(shingles))).astype(np.int64)) if len(shingles) else 0
