"""Quality classifier: regularised quadratic discriminant over transformed statistics of each text."""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import fold, stored, text_of

#: Words in a block, for the statistics of a text's worst block.
BLOCK = 40
FEATURES = ("length", "word", "distinct", "digits", "upper", "marks", "bars", "again", "lines", "worst_upper", "worst_marks", "worst_bars", "worst_again")
_MARKS = "$%&*#!"


def _shares(words: list[str]) -> list[float]:
    """Shares of a block's words: in capitals, with marks, bars, and equal to the word before."""
    n = len(words) or 1
    joined = " ".join(words)
    return [
        sum(map(str.isupper, words)) / n,
        min(1.0, sum(map(joined.count, _MARKS)) / n),
        joined.count("|") / n,
        sum(map(eq, words, words[1:])) / n,
    ]


def text_statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; the empty text has them too."""
    words = text.split()
    n = len(words)
    starts = range(0, max(n - BLOCK // 2, 1), BLOCK)
    # a tail too short for a block of its own goes with the last one
    blocks = [_shares(words[k : k + BLOCK if k != starts[-1] else n]) for k in starts]
    weights = np.full(len(blocks), BLOCK, float)
    weights[-1] = max(n - BLOCK * (len(blocks) - 1), 1)
    table = np.array(blocks)
    mean, worst = weights @ table / weights.sum(), table.max(0)
    lines = text.split("\n")
    chars = max(len(text), 1)
    return [
        float(np.log1p(n)),
        float(np.log((len(text) + 1) / (n + 1))),
        float(np.log((len(set(words)) + 1) / (n + 1)) / (1 + np.log1p(n))),
        float(np.log(sum(map(text.count, "0123456789")) / chars + 0.01)),
        *np.log(mean + 0.05).tolist(),
        float(np.log((len(lines) - len(set(lines))) / len(lines) + 0.05)),
        *np.log(worst + 0.05).tolist(),
    ]


def statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([text_statistics(t) for t in texts])


class Discriminant:
    """Two Gaussian classes with shrunk covariances and their Cholesky factors, made once from sums.

    ``moments`` has for each class 0 and 1 the count, the sums and the sums of products of the statistics.
    A class's covariance is mixed with the pooled one and with the pooled variances by ``shrink``."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.15, ridge: float = 1e-3):
        total = sum(n for n, _, _ in moments.values())
        self.known = set(moments) == {0, 1} and all(n > 1 for n, _, _ in moments.values())
        if not self.known:
            return
        own = {c: (s / n, q / n - np.outer(s / n, s / n)) for c, (n, s, q) in moments.items()}
        pooled = sum(moments[c][0] / total * own[c][1] for c in own)
        base = np.diag(np.diag(pooled)) + ridge * np.eye(len(pooled))
        self.means, self.whiten, self.shift = {}, {}, {}
        for c, (mean, cov) in own.items():
            a = max(shrink, min(1.0, 2 * len(mean) / moments[c][0]))
            factor = np.linalg.cholesky((1 - a) * cov + a * (pooled + base) / 2 + ridge * np.eye(len(mean)))
            # the inverse of the small triangular factor is made once; a batch is only multiplied with it
            self.means[c], self.whiten[c] = mean, np.linalg.inv(factor)
            self.shift[c] = np.log(moments[c][0] / total) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1; 0.5 for all where one class was not seen."""
        if not self.known:
            return np.full(len(x), 0.5)
        log = {c: self.shift[c] - 0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def fit(rows: DataFrame) -> Discriminant:
    """From rows (x, label): all of them, as sums that each task makes and the driver gets once a class."""
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in pairs]
    moments = {}
    for r in rows.where("label IN (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        products = np.zeros((k, k))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"q{i}_{j}"]
        moments[r["label"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(k)]), products)
    return Discriminant(moments)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows (doc_id, held_out, score) of all ``docs``; ``labels`` has the id and the label 0 or 1.

    The model learns from the labelled documents whose crc32(id) mod 4 is not 2. Defined cases: a null text
    counts as empty, and an empty one is scored like any other; labels other than 0 and 1 are left out; a
    repeated document or label counts as often as it comes; without documents of both labels every score is
    0.5; other columns are ignored; an empty table gives no row.
    """
    # the texts are read once: what is kept of each is its statistics
    made = F.pandas_udf(statistics, "array<double>")
    seen = stored(docs.select(F.col(f"`{doc_id}`").alias("id"), made(text_of(text)).alias("x")), "quality-statistics")
    held_out = F.coalesce(fold("id", 4) == 2, F.lit(False))
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(fit(seen.where(~held_out).join(known, "id")))

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return seen.select(F.col("id").alias(doc_id), held_out.alias("held_out"), scored("x").alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
