"""Secret scan: known shapes, and a battery of randomness tests with control of false discoveries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc, exp, log, sqrt
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import cell as cell_of
from larkspan.llm.common import stored, text_of, version

#: Fixed patterns. A match whose last group is too short is dropped, but what it covers stays used up.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

#: What the battery looks at: strings of at least LEAST characters that could be encoded bytes. An equals sign ends
#: them, so that a name before it isn't part of the value; padding does too, where nothing follows it.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
CAPITALISED = re.compile(r"[A-Z][a-z]+")
#: Length classes begin at these lengths; scores fall in so many cells.
LENGTHS = (16, 18, 20, 22, 24, 28, 32, 40, 48, 64, 96, 128)
CELLS = 60
Q = 0.05
#: Plain strings of a class under which those of shorter classes are taken too.
FEW = 40

#: For each encoding its symbols, in cells for the chi-squared test. Letters are dealt by how common they are in
#: the corpus's languages.
ENCODINGS = {
    "hex": ("01234", "56789", "abc", "def"),
    "HEX": ("01234", "56789", "ABC", "DEF"),
    "lower": ("etaoin", "shrdlcu", "mwfgypbvkjxqz"),
    "UPPER": ("ETAOIN", "SHRDLCU", "MWFGYPBVKJXQZ"),
    "base32": ("ETAOIN", "SHRDLCU", "MWFGYPBVKJXQZ", "234567"),
    "base36": ("etaoin", "shrdlcu", "mwfgypbvkjxqz", "01234", "56789"),
    "BASE36": ("ETAOIN", "SHRDLCU", "MWFGYPBVKJXQZ", "01234", "56789"),
    "base64": ("etaoin", "shrdlcu", "mwfgypbvkjxqz", "ETAOIN", "SHRDLCU", "MWFGYPBVKJXQZ", "01234", "56789", "+/-_"),
}
_PLACES = {name: {c: (k, i) for i, c in enumerate(sorted("".join(cells))) for k in [next(j for j, cell in enumerate(cells) if c in cell)]} for name, cells in ENCODINGS.items()}
NAMES = list(ENCODINGS)
#: Encodings of which the symbols are dealt alike, but for the case of their letters, look the same at prose.
_ALIKE = {"hex": ("hex", "HEX"), "lower": ("lower", "UPPER"), "base32": ("base32",), "base36": ("base36", "BASE36"), "base64": ("base64",)}
_U = np.uint64
#: Characters of texts of which the pieces are judged at a time.
PIECES = 1 << 18
#: Logarithms of erfc from -_REACH on, _STEPS for each whole number, and score cells by half of Fisher's statistic.
_REACH, _STEPS, _FINE = 8, 1024, 1 << 14
_LOG_ERFC = np.array([log(max(erfc(k / _STEPS - _REACH), 1e-300)) for k in range((_REACH + 27) * _STEPS)])



def encoding(token: str) -> str | None:
    """The smallest encoding that has all of the token's symbols; None for numbers."""
    token = token.rstrip("=")
    symbols = set(token.lower() if CAPITALISED.fullmatch(token) else token)
    if symbols <= set("0123456789"):
        return None
    return next((name for name, places in _PLACES.items() if symbols <= places.keys()), None)


def randomness(token: str, name: str) -> float:
    """The probability that bytes in this encoding look less random than the token: chi-squared over the
    alphabet's cells, runs above and below the middle, and correlation of neighbours, by Fisher's rule."""
    places, cells = _PLACES[name], ENCODINGS[name]
    pairs = [places[c] for c in token.rstrip("=")]
    n, m = len(pairs), len(places)
    if n < 8:
        return 0.0
    seen = [0] * len(cells)
    for k, _ in pairs:
        seen[k] += 1
    chi = sum((o - n * len(c) / m) ** 2 / (n * len(c) / m) for o, c in zip(seen, cells))
    d = len(cells) - 1
    z = ((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / sqrt(2 / (9 * d))
    values = [i for _, i in pairs]
    high = [2 * i >= m for i in values]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 1 + 2 * a * b / n
    spread = sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    centre = sum(values) / n
    off = [v - centre for v in values]
    power = sum(v * v for v in off)
    serial = sum(x * y for x, y in zip(off, off[1:])) / power * sqrt(n) if power else 9.0
    tails = [0.5 * erfc(z / sqrt(2)), erfc(abs(runs - mean) / spread / sqrt(2)), erfc(abs(serial + 1 / sqrt(n)) / sqrt(2))]
    half = -sum(log(max(p, 1e-300)) for p in tails)
    return exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0


def _score(p: float) -> int:
    return min(int(-log(max(1 - p, 1e-12)) * 4 + 30), CELLS - 1) if p > 0.5 else max(30 + int(log(max(2 * p, 1e-12)) * 2), 0)


_SCORES = np.array([_score(exp(-h) * (1 + h + h * h / 2)) for h in ((k + 0.5) / _FINE for k in range(30 * _FINE))])


def _cell(token: str, name: str) -> int:
    """Encoding, length class and score cell in one number; a higher cell is more random."""
    score = _score(randomness(token, name))
    of_length = max(k for k, n in enumerate(LENGTHS) if len(token.rstrip("=")) >= n)
    return (NAMES.index(name) * len(LENGTHS) + of_length) * CELLS + score


def cell(token: str) -> int | None:
    """The cell of a candidate; None for numbers."""
    name = encoding(token)
    return _cell(token.lower() if CAPITALISED.fullmatch(token) else token, name) if name else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the known shapes in one whole text, by start and then kind."""
    low, out = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _log_erfc(x: np.ndarray) -> np.ndarray:
    at = np.clip((x + _REACH) * _STEPS, 0, len(_LOG_ERFC) - 2)
    k = at.astype(np.int64)
    return _LOG_ERFC[k] + (at - k) * (_LOG_ERFC[k + 1] - _LOG_ERFC[k])


def _written(texts: list[str], name: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts' words in this encoding, and where each text begins in them."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    chars = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    symbols, letters = np.frombuffer("".join(_PLACES[name]).encode(), np.uint8), np.arange(256, dtype=np.uint8)
    small, big = (letters >= 97) & (letters <= 122), (letters >= 65) & (letters <= 90)
    if not big[symbols].any():
        chars = np.where(big, letters + 32, letters)[chars]
    elif not small[symbols].any():
        chars = np.where(small, letters - 32, letters)[chars]
    else:
        first = np.concatenate([[True], np.isin(letters, list(b" \t\n\v\f\r"))[chars[:-1]]])
        chars = chars - (first & small[chars]) * np.uint8(32)
    own = np.isin(letters, symbols)[chars]
    return chars[own], np.concatenate([[0], np.cumsum(own)])[np.cumsum([0] + [len(r) + 1 for r in raw])]


def _runs_tails(n: int) -> np.ndarray:
    """The logarithm of the runs test's tail for strings of length n, by symbols above the middle and changes."""
    a, changes = np.arange(n + 1)[:, None], np.arange(n + 1)
    mean = 1 + 2 * a * (n - a) / n
    return _log_erfc(np.abs(1 + changes - mean) / np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)) / sqrt(2)).ravel()


def _pieces(texts: list[str], name: str) -> np.ndarray:
    """How many pieces are in each cell (length class, score) of this encoding: ``_cell`` for all pieces at once."""
    symbols, bounds = _written(texts, name)
    cells, m = ENCODINGS[name], len(_PLACES[name])
    d, out = len(cells) - 1, np.zeros((len(LENGTHS), CELLS), np.int64)
    if len(symbols) < LENGTHS[0]:
        return out.ravel()
    # two numbers hold a piece's sums side by side, as each is small: how many symbols are in each cell but the first;
    # and values, changes between high and low, squares, products of neighbours. Running sums may wrap.
    counted, summed, values = np.zeros(256, _U), np.zeros(256, _U), np.zeros(256, np.uint32)
    for c, (cell, i) in _PLACES[name].items():
        counted[ord(c)] = 1 << 8 * (cell - 1) if cell else 0
        summed[ord(c)], values[ord(c)] = i + (i * i << 24), i | (2 * i >= m) << 16
    value = np.take(values, symbols)
    beside = np.zeros(len(symbols), _U)
    beside[:-1] = ((value[1:] ^ value[:-1]) >> np.uint32(16)).astype(_U) << _U(16)
    high = np.concatenate([[0], np.cumsum(value >> np.uint32(16), dtype=np.int64)])
    value &= np.uint32(255)
    beside[:-1] += (value[1:] * value[:-1]).astype(_U) << _U(44)
    counts, sums = np.zeros(len(symbols) + 1, _U), np.zeros(len(symbols) + 1, _U)
    np.cumsum(np.take(counted, symbols), out=counts[1:])
    np.cumsum(np.take(summed, symbols) + beside, out=sums[1:])
    weights = np.array([m / len(c) for c in cells], np.float32)
    for of_length, n in enumerate(LENGTHS):
        times = np.diff(bounds) // n
        if not times.any():
            continue
        i = np.repeat(bounds[:-1] - n * (np.cumsum(times) - times), times) + n * np.arange(times.sum())
        last = i + (n - 1)
        of = (np.take(counts, last + 1) - np.take(counts, i)).view(np.uint8).reshape(-1, 8)[:, :d].astype(np.float32)
        of_sums = (np.take(sums, last + 1) - np.take(sums, i) - np.take(beside, last)).astype(np.int64)
        others = n - of @ np.ones(d, np.float32)
        chi = ((of * of) @ weights[1:] + others * others * weights[0]) / n - n
        highs = np.take(high, last + 1) - np.take(high, i)
        z = (np.cbrt(np.maximum(chi, 0) / d) - (1 - 2 / (9 * d))) / sqrt(2 / (9 * d))
        total = of_sums & 0xFFFF
        centre = total / n
        power = (of_sums >> 24 & 0xFFFFF) - total * centre
        near = (of_sums >> 44) - centre * (2 * total - np.take(value, i) - np.take(value, last)) + (n - 1) * centre * centre
        serial = np.where(power > 1e-6, near / np.maximum(power, 1e-6) * sqrt(n), 9.0)
        tails = log(0.5) + _log_erfc(z / sqrt(2)) + np.take(_RUNS[n], highs * (n + 1) + (of_sums >> 16 & 0xFF)) + _log_erfc(np.abs(serial + 1 / sqrt(n)) / sqrt(2))
        half = np.clip(tails * -_FINE, 0, len(_SCORES) - 1).astype(np.int32)
        out[of_length] = np.bincount(np.take(_SCORES, half), minlength=CELLS)
    return out.ravel()


_RUNS = {n: _runs_tails(n) for n in LENGTHS}


def null_counts(texts: list[str]) -> np.ndarray:
    """How many pieces of the texts are in each cell. The words of a text are written together as an encoding writes
    them, and all that it has is cut to pieces of each of LENGTHS, for every encoding: what strings that mean something
    look like in that encoding at that length."""
    out = np.zeros((len(NAMES), len(LENGTHS) * CELLS), np.int64)
    for name, alike in _ALIKE.items():
        out[[NAMES.index(other) for other in alike]] = _pieces(texts, name)
    return out.ravel()


def prose(text: str, name: str | None = None) -> list[int]:
    """The cells of a text's pieces in one encoding or all, each as often as the text has it."""
    counts = null_counts([text])
    cells = np.repeat(np.arange(len(counts)), counts)
    return [int(c) for c in cells if name is None or NAMES[c // CELLS // len(LENGTHS)] == name]


def _null(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, block, size = np.zeros(len(NAMES) * len(LENGTHS) * CELLS, np.int64), [], 0
    for batch in batches:
        for text in batch["text"]:
            block.append(text)
            size += len(text)
            if size >= PIECES:
                counts += null_counts(block)
                block, size = [], 0
    counts += null_counts(block)
    yield pd.DataFrame({"cell": np.flatnonzero(counts), "count": counts[counts > 0]})


def _scan(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for key, version, text in zip(batch["id"], batch["v"], batch["text"]):
            base, found = base_spans(text), []
            for m in CANDIDATE.finditer(text):
                if not any(s < m.end() and m.start() < e for _, s, e in base) and (place := cell(m[0])) is not None:
                    found.append({"start": m.start(), "end": m.end(), "cell": place, "mark": crc32(m[0].encode()) << 31 ^ crc32(m[0][::-1].encode())})
            rows.append((key, version, [{"kind": k, "start": s, "end": e} for k, s, e in base], found))
        yield pd.DataFrame(rows, columns=["id", "v", "base", "found"])


def discoveries(tested: dict[int, int], plain: dict[int, int]) -> dict[int, int]:
    """For each encoding and length class the least score cell that counts as a discovery.

    A cell's p-value is the share of plain strings of that encoding and length with that score or a higher one, one
    string more added to both; the cell is the lowest for which p * tested / (tested at least so random) is at most Q.
    Where there are few plain strings, those of shorter classes, which look more random, are taken too."""
    least = {}
    for k in range(len(NAMES) * len(LENGTHS)):
        nulls = [0] * CELLS
        for shorter in range(k % len(LENGTHS) + 1):
            if sum(nulls) < FEW:
                nulls = [n + plain.get((k - shorter) * CELLS + j, 0) for j, n in enumerate(nulls)]
        cases = [tested.get(k * CELLS + j, 0) for j in range(CELLS)]
        for j in range(CELLS):
            above = sum(cases[j:])
            if above and (1 + sum(nulls[j:])) / (1 + sum(nulls)) * sum(cases) / above <= Q:
                least[k] = j
                break
    return least


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, base, added): arrays of (kind, start, end) in code points, each by start.

    The battery tests every string of LEAST characters or more but numbers, in the smallest encoding that has its
    symbols; all words of every document, written in each of the encodings, are the null of the discovery control of
    that encoding. All are counted over all documents, each string and text once, as a table of ENCODINGS x LENGTHS x CELLS cells.
    Defined cases: a null text counts as empty and has no spans; rows that repeat, or have null ids, get the spans of
    their text each; numbers
    are never added, nor what overlaps a known shape; other columns are ignored; an empty table gives no row.
    """
    span = "struct<kind:string,start:long,end:long>"
    scanned = docs.select(F.col(f"`{doc_id}`").alias("id"), version(text).alias("v"), text_of(text).alias("text"))
    kind = scanned.schema["id"].dataType.simpleString()
    seen = stored(scanned.mapInPandas(_scan, f"id {kind}, v long, base array<{span}>, found array<struct<start:long,end:long,cell:int,mark:long>>"), "secrets-seen")
    count = lambda cells: {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    tested = seen.select(F.explode("found").alias("found")).select("found.cell", "found.mark").distinct()
    # only texts that may come more than once are shuffled
    several = F.broadcast(seen.groupBy("v").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(cell_of("v").alias("cell")).distinct())
    texts = scanned.select("v", "text", cell_of("v").alias("cell"))
    once = texts.join(several, "cell", "left_anti").unionByName(texts.join(several, "cell", "left_semi").dropDuplicates(["v"]))
    nulls = once.select("text").mapInPandas(_null, "cell int, count long").groupBy("cell").agg(F.sum("count").alias("count"))
    least = discoveries(count(tested), {r["cell"]: r["count"] for r in nulls.collect()})
    passes = lambda c: F.lit(False)
    if least:
        floors = F.create_map(*[F.lit(x) for k, j in sorted(least.items()) for x in (k, j)])
        passes = lambda c: F.coalesce(c % CELLS >= F.try_element_at(floors, F.floor(c / CELLS).cast("int")), F.lit(False))
    added = F.transform(F.filter("found", lambda x: passes(x["cell"])), lambda x: F.struct(F.lit("random").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return seen.select(F.col("id").alias(doc_id), "base", added.alias("added"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(keyed)).alias("spans"),
    )
