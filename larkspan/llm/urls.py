"""URL filter: allow and block rules, then a character language-model ratio.

Two interpolated Markov models of variable order are counted over all URLs that the rules accept and reject.
A URL that no rule fits is judged by the mean difference of its characters' log-likelihoods under the two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Symbol 0 is the border, 1 any other character; every digit is "0".
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:~+@,"
N = len(ALPHABET) + 2
ORDER = 3
#: Contexts seen fewer times than this take the shorter context's distribution.
LEAST = 3
BINS = 400
_CODES = np.ones(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i + 2
    _CODES[ord(_c.upper())] = _i + 2
_CODES[ord("0") : ord("9") + 1] = ALPHABET.index("0") + 2


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(F.col(f"`{url}`"), pattern, k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def longest_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, start = text.partition("/")
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _symbols(urls: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Each URL's symbols, with ORDER borders before it and one behind, joined; and where each URL starts."""
    raw = [s.encode("latin-1", "replace") for s in urls]
    pad = b"\n" * ORDER
    lengths = np.fromiter((len(r) for r in raw), np.int64, len(raw)) + ORDER + 1
    joined = np.frombuffer(b"".join(pad + r.replace(b"\n", b" ") + b"\n" for r in raw), np.uint8)
    codes = _CODES[joined].copy()
    codes[joined == 10] = 0
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """For each place the number of the gram of ``order`` symbols before it and its own."""
    out = codes.copy()
    power = 1
    for k in range(1, order + 1):
        power *= N
        out[k:] += codes[:-k] * power
    return out


def _inner(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places hold a URL's own symbols or its end."""
    mask = np.ones(len(codes), bool)
    for k in range(ORDER):
        mask[starts + k] = False
    return mask


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for accepted, part in batch.groupby("accepted"):
            codes, starts = _symbols(part["u"])
            keys, counts = np.unique(_grams(codes, ORDER)[_inner(codes, starts)], return_counts=True)
            yield pd.DataFrame({"accepted": accepted, "gram": keys, "n": counts})


def _log_table(counts: np.ndarray) -> np.ndarray:
    """log p(symbol | ORDER symbols before it), Witten-Bell interpolation over orders 0 to ORDER."""
    p = np.full(N, 1.0 / N)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, N ** (order + 1)).sum(0).reshape(-1, N)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        lower = np.tile(p, (N, 1)) if order > 1 else np.broadcast_to(p, n.shape)
        mixed = (n + kinds * lower) / np.maximum(total + kinds, 1)
        p = np.where(total >= LEAST, mixed, lower)
    return np.log(p).astype(np.float32).ravel()


def fit_ratio(labelled: DataFrame) -> np.ndarray:
    """The table of log-likelihood differences, from rows (u, accepted).

    Every row is counted. The result has N ** (ORDER + 1) numbers however many rows there are, and so have the
    counts that reach the driver, at most twice."""
    counts = np.zeros((2, N ** (ORDER + 1)))
    grams = labelled.mapInPandas(_count, "accepted boolean, gram long, n long").groupBy("accepted", "gram").agg(F.sum("n").alias("n"))
    found = grams.toPandas()
    if found["accepted"].nunique() < 2:
        return np.zeros(N ** (ORDER + 1), np.float32)
    counts[found["accepted"].astype(int).to_numpy(), found["gram"].to_numpy()] = found["n"].to_numpy()
    return _log_table(counts[1]) - _log_table(counts[0])


def ratio_scores(urls: pd.Series, table: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference a symbol; 0 for the empty URL."""
    codes, starts = _symbols(urls)
    if not len(starts):
        return np.zeros(0)
    values = np.where(_inner(codes, starts), table[_grams(codes, ORDER)], 0.0)
    lengths = np.diff(np.append(starts, len(codes))) - ORDER
    return np.where(lengths > 1, np.add.reduceat(values, starts) / lengths, 0.0)


def threshold(scored: DataFrame) -> float:
    """The score from which on a URL is accepted, calibrated on rows (score, accepted).

    Of the thresholds whose two error rates sum to no more than a standard error above the least sum, the one nearest
    to 0, where the models themselves are even; the more rows, the less it moves from the least error. Only a
    histogram of BINS cells reaches the driver. 0 without rows of both."""
    cell = F.least(F.greatest(F.floor(F.col("score") * (BINS / 8) + BINS / 2), F.lit(0)), F.lit(BINS - 1))
    n = np.zeros((2, BINS))
    for accepted, k, rows in scored.groupBy("accepted", cell.alias("k")).count().collect():
        n[int(accepted), k] += rows
    total = n.sum(1, keepdims=True)
    if not total.all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, 1)], 1)
    wrong = np.stack([total[0] - below[0], below[1]])
    errors, smoothed = (wrong / total).sum(0), (wrong + 1) / (total + 2)
    spread = np.sqrt((smoothed * (1 - smoothed) / total).sum(0))
    best = np.flatnonzero(errors <= errors.min() + spread[errors.argmin()])
    return float((best[np.argmin(np.abs(best - BINS / 2))] - BINS / 2) / (BINS / 8))


def filter_urls(pages: DataFrame, url: str = "url", rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict.

    The models learn from all URLs that a rule fits, but for a fifth of them (by hash) on which the threshold is
    calibrated. Defined cases: a null URL or one without ``://`` has empty host and path, no rule and score 0, and is judged
    by the threshold as others are; null or repeated ids matter nowhere; repeated rows count as often as they come;
    very long URLs are read whole; without URLs of both verdicts every score and the threshold are 0, so that other
    URLs are allowed; an empty table gives no row. Columns of ``pages`` with the names of new ones are replaced.
    """
    spark = pages.sparkSession
    host, path = url_parts(url)
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    known = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_says": says})
    whole = F.when(F.col(f"`{url}`").contains("://"), F.regexp_replace(F.col(f"`{url}`"), r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rows = known.where(F.col("rule").isNotNull()).select(whole.alias("u"), (F.col("_says") == "allow").alias("accepted"))
    aside = F.pmod(F.xxhash64("u"), F.lit(5)) == 0
    table = spark.sparkContext.broadcast(fit_ratio(rows.where(~aside)))

    @F.pandas_udf("double")
    def score(u: pd.Series) -> pd.Series:
        return pd.Series(ratio_scores(u, table.value))

    least = threshold(rows.where(aside).select(score("u").alias("score"), "accepted"))
    by_model = F.when(F.col("score") >= least, "allow").otherwise("block")
    scored = known.withColumn("score", score(whole))
    return scored.withColumn("verdict", F.coalesce("_says", by_model)).drop("_says")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
