"""Toxicity by a weighted finite-state pattern grammar.

A clause's words are read as classes: insult, harm, target, negation, reporting verb, other. Five transducers are
composed once. The negation and the report transducer rewrite the insults and harms in their reach; what they let
through is weighed by the insult, the threat and the target transducer, which look for a target on either side. So a
clause is scored, not a word: the same insult counts when it is said, and doesn't when it is denied or quoted. Which
words are insults is learned: the lexicon has the words and word stems that so many unrelated toxic documents share,
and so few clean ones, as chance among all words can't explain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import fold, stored, text_of
from larkspan.llm.components import components
from larkspan.llm.shingles import mix, shingle_sets

#: At most so many labelled documents of each label are learned from, those with the smallest hash of their id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 5000, 10000
#: Near copies of a text meet at one of so many bands and count as one.
BANDS = 4
#: Lengths of the word stems that can become part of the lexicon.
STEMS = (4, 5, 6)
#: A form of the lexicon is so many times as frequent among toxic families as among clean ones, at least.
LEAST_ODDS = 100
#: And is expected by chance less often than this among all forms seen.
BY_CHANCE = 0.05
WORD = re.compile(r"[^\W\d_]+")
#: A word of a clause, with what an apostrophe joins to it.
JOINED = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n]")

#: Closed word classes in the corpus's languages (fixed values).
HARMS = frozenset("kill hurt destroy murder beat töten umbringen schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours du dich dir ihr euch tu te toi vous usted ustedes tú ti".split())
NEGATIONS = frozenset("not never no nor neither nicht kein keine keinen keiner nie ne pas jamais nunca".split())
REPORTS = frozenset("said says say wrote claimed claims quoted called sagte sagt schrieb behauptete disait dit écrit dijo dice escribió".split())
INSULT, HARM, TARGET, NEGATION, REPORT, OTHER = "IHYNRO"
#: What is denied and what is reported, as the first two transducers write it.
DENIED, QUOTED = "d", "q"

#: Evidence: of a harm alone, added by a target, by a harm's target, and by a report that comes after an insult.
HARM_WEIGHT, TARGETED, THREATENED, REPORTED_AFTER = 0.5, 1.0, 2.0, -2.2
#: What is left of an insult that is denied or reported.
DENIED_SHARE, QUOTED_SHARE = 0.1, 0.3
#: Words that a negation reaches, and that may stand between a harm and its target.
NEGATED_WORDS, THREAT_WORDS = 3, 4
#: A text with this evidence scores 0.5.
BIAS, STEEP = 1.6, 2.5


class Transducer:
    """``arcs``: (state, symbol) -> (next state, symbol written, share, bonus); what is missing keeps state and symbol,
    with share 1 and bonus 0. The evidence of a word is its own weight by the share, and the bonus. Starts in state 0."""

    def __init__(self, arcs: dict[tuple, tuple]):
        self.arcs = arcs

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0, 0.0))

    def compose(self, other: Transducer) -> Transducer:
        """What this one writes is read by the other; shares multiply, bonuses add. States are numbered as reached."""
        arcs, numbers, todo = {}, {(0, 0): 0}, [(0, 0)]
        for a, b in todo:
            for symbol in INSULT + HARM + TARGET + NEGATION + REPORT + OTHER + DENIED + QUOTED:
                c, middle, share, bonus = self.step(a, symbol)
                d, written, more, extra = other.step(b, middle)
                if (c, d) not in numbers:
                    numbers[c, d] = len(numbers)
                    todo.append((c, d))
                arcs[numbers[a, b], symbol] = numbers[c, d], written, share * more, bonus + extra
        return Transducer(arcs)

    def evidence(self, symbols: str, weights: list[float]) -> float:
        state, total = 0, 0.0
        for symbol, weight in zip(symbols, weights):
            state, _, share, bonus = self.step(state, symbol)
            total += share * weight + bonus
        return total


def negation() -> Transducer:
    """A negation denies the insults and harms among the next NEGATED_WORDS words."""
    arcs = {}
    for left in range(NEGATED_WORDS + 1):
        arcs[left, NEGATION] = NEGATED_WORDS, NEGATION, 1.0, 0.0
        if left:
            arcs |= {(left, s): (left - 1, DENIED if s in (INSULT, HARM) else s, 1.0, 0.0) for s in (INSULT, HARM, TARGET, REPORT, OTHER)}
    return Transducer(arcs)


def report() -> Transducer:
    """After a reporting verb, insults and harms are quoted; one after an insult takes back what it weighed."""
    arcs = {(0, REPORT): (1, REPORT, 1.0, 0.0), (0, INSULT): (2, INSULT, 1.0, 0.0), (2, REPORT): (1, REPORT, 1.0, REPORTED_AFTER)}
    arcs |= {(1, s): (1, QUOTED, 1.0, 0.0) for s in (INSULT, HARM, DENIED)}
    return Transducer(arcs)


def insult() -> Transducer:
    """An insult weighs what it weighs, a denied or quoted one a share of it."""
    return Transducer({(0, DENIED): (0, DENIED, DENIED_SHARE, 0.0), (0, QUOTED): (0, QUOTED, QUOTED_SHARE, 0.0)})


def threat() -> Transducer:
    """A harm and its target, in either order, with fewer than THREAT_WORDS words between them."""
    arcs = {}
    for state in range(2 * THREAT_WORDS + 1):  # 1 to THREAT_WORDS: a harm was seen; above: a target was
        seen_harm, seen_target = 0 < state <= THREAT_WORDS, state > THREAT_WORDS
        arcs[state, HARM] = (0, HARM, 1.0, THREATENED) if seen_target else (THREAT_WORDS, HARM, 1.0, 0.0)
        arcs[state, TARGET] = (0, TARGET, 1.0, THREATENED) if seen_harm else (2 * THREAT_WORDS, TARGET, 1.0, 0.0)
        passed = 0 if state in (0, 1, THREAT_WORDS + 1) else state - 1
        arcs |= {(state, s): (passed, s, 1.0, 0.0) for s in (INSULT, NEGATION, REPORT, OTHER, DENIED, QUOTED)}
    return Transducer(arcs)


def target() -> Transducer:
    """An insult in a clause with a target, before or after it, weighs more; once a clause."""
    return Transducer({
        (0, TARGET): (1, TARGET, 1.0, 0.0), (0, INSULT): (2, INSULT, 1.0, 0.0),
        (1, INSULT): (3, INSULT, 1.0, TARGETED), (2, TARGET): (3, TARGET, 1.0, TARGETED),
    })


GRAMMAR = negation().compose(report()).compose(insult()).compose(threat()).compose(target())


def forms(text: str) -> set[str]:
    """The text's words ("=word") and their stems ("^stem")."""
    words = set(WORD.findall(text.lower()))
    return {f"={w}" for w in words if len(w) > 2} | {f"^{w[:k]}" for w in words for k in STEMS if len(w) > k}


def _count_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = [Counter(), Counter()]
        for text, label in zip(batch["text"], batch["label"]):
            seen[label].update(forms(text))
        for label in (0, 1):
            if seen[label]:
                yield pd.DataFrame({"form": list(seen[label]), "label": label, "n": list(seen[label].values())})


class Lexicon:
    """Insults with their log odds; ``pattern`` finds them as whole words or stems, and harms."""

    def __init__(self, odds: dict[str, float]):
        # on the scale of the grammar's evidence: from 2 on, 3 at most
        weights = {f: 2 + min(w, 10.0) / 10 for f, w in odds.items()}
        self.words = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        self.stems = {f[1:]: w for f, w in weights.items() if f[0] == "^"}
        whole = sorted({*self.words, *HARMS})
        parts = [re.escape(w) + r"(?![^\W\d_])" for w in whole] + [re.escape(w) for w in self.stems]
        self.pattern = re.compile(r"(?<![^\W\d_])(?:" + "|".join(parts) + ")")

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k)])

    def read(self, word: str) -> tuple[str, float]:
        """The class and the weight of a word of a clause; an apostrophe joins parts that are looked at each."""
        parts = word.replace("’", "'").split("'")
        if weight := max(map(self.weight, parts)):
            return INSULT, weight
        if parts[-1] == "t" and len(parts) > 1 and parts[-2][-1] == "n" or parts[0] == "n" and len(parts) > 1:
            return NEGATION, 0.0
        for symbol, words, weight in ((HARM, HARMS, HARM_WEIGHT), (NEGATION, NEGATIONS, 0.0), (TARGET, TARGETS, 0.0), (REPORT, REPORTS, 0.0)):
            if not words.isdisjoint(parts):
                return symbol, weight
        return (TARGET, 0.0) if parts[0] == "t" and len(parts) > 1 else (OTHER, 0.0)

    def clause(self, words: list[str]) -> float:
        read = [self.read(w) for w in words]
        return GRAMMAR.evidence("".join(s for s, _ in read), [w for _, w in read])

    def clauses(self, text: str) -> list[float]:
        """The evidence of each clause of the whole text in which something matched."""
        low, found, end = text.lower(), [], -1
        for hit in self.pattern.finditer(low):
            if hit.start() < end:
                continue
            begin = max((low.rfind(c, max(end, 0), hit.start()) for c in ".!?;:\n")) + 1 or max(end, 0)
            stop = CLAUSE_END.search(low, hit.end())
            end = stop.start() if stop else len(low)
            found.append(self.clause(JOINED.findall(low, begin, end)))
        return found

    def score(self, text: str) -> float:
        """Of the strongest clause, to which the others add a tenth."""
        evidence = sorted(self.clauses(text), reverse=True)
        total = evidence[0] + 0.1 * min(sum(max(e, 0.0) for e in evidence[1:]), 20.0) if evidence else 0.0
        return 1 / (1 + exp(STEEP * (BIAS - min(max(total, -10.0), 20.0))))


def family_keys(texts: pd.Series) -> pd.Series:
    """For each text the keys of BANDS bands of two MinHash values of its five-word shingles."""
    salts, out = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64)), []
    for shingles in shingle_sets(texts):
        least = np.array([mix(shingles ^ salt).min(initial=np.uint64(2**64 - 1)) for salt in salts])
        out.append(mix(least[::2] * np.uint64(31) + least[1::2] + np.arange(BANDS, dtype=np.uint64)).astype(np.int64))
    return pd.Series(out)


def with_families(rows: DataFrame) -> DataFrame:
    """Rows (text, label, family) of rows (text, label): texts that share a band, directly or by way of others, are one
    family, of which one text of each label stays."""
    made = F.pandas_udf(family_keys, "array<bigint>")
    keyed = stored(rows.withColumns({"node": F.xxhash64("text"), "keys": made("text")}), "toxicity-sample")
    links = keyed.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.min("node").alias("hub"), F.collect_set("node").alias("nodes"))
    found = components(links.select("hub", F.explode("nodes").alias("node")).where("node <> hub"), "hub", "node")
    return keyed.join(found.withColumnRenamed("label", "family"), "node", "left").withColumn("family", F.coalesce("family", "node")).dropDuplicates(["family", "label"]).select("text", "label", "family")


def most_telling(found: dict[str, tuple[int, float]], share: float = 0.9) -> dict[str, float]:
    """Of forms with (toxic families, weight), those that say most: a stem goes if one longer form, a stem or a
    word, has at least ``share`` of its families, as the shorter fits clean words more easily; what begins with a
    stem that stays is needless."""
    longer: dict[str, int] = {}
    for form, (n, _) in found.items():
        for k in STEMS:
            stem = f"^{form[1:][:k]}"
            if stem != form and len(form) - 1 >= k:
                longer[stem] = max(longer.get(stem, 0), n)
    kept = {f: w for f, (n, w) in found.items() if f[0] == "=" or longer.get(f, 0) < share * n}
    inside = lambda f: any(f"^{f[1:][:k]}" in kept and f"^{f[1:][:k]}" != f for k in STEMS if len(f) - 1 > k)
    return {f: w for f, w in kept.items() if not inside(f)}


def fit(docs: DataFrame, labelled: DataFrame) -> Lexicon:
    """From docs (id, text) and labelled (id, label); a bounded sample of the labelled ones, see TOXIC_SAMPLE.

    A form's evidence is the number of families of toxic and of clean texts that have it, so that the words of
    one text with many near copies don't look like insults."""
    sample = None
    for label, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        part = labelled.where(F.col("label") == label).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    # at most TOXIC_SAMPLE + CLEAN_SAMPLE ids
    own = docs.join(F.broadcast(sample), "id").select("text", F.col("label").cast("int").alias("label"))
    rows = stored(with_families(own), "toxicity-families")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    forms_seen = rows.mapInPandas(_count_forms, "form string, label int, n long")
    counts = stored(forms_seen.groupBy("form").agg(of(1).alias("t"), of(0).alias("c")), "toxicity-forms")
    # the chance that all of so many families with the form are toxic, if toxic and clean ones had it alike
    share = toxic / (toxic + clean)
    seen = counts.count()
    least = log(max(seen, 1) / BY_CHANCE) / -log(share)
    odds = F.log((F.col("t") + 0.1) / (toxic + 0.2)) - F.log((F.col("c") + 0.1) / (clean + 0.2))
    # what passes comes from the sample, and so has its bound
    picked = counts.where(F.col("t") >= least).withColumn("w", odds).where(F.col("w") > log(LEAST_ODDS)).collect()
    return Lexicon(most_telling({r["form"]: (r["t"], r["w"]) for r in picked}))


def learned(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> Lexicon:
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), text_of(text).alias("text"))
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("label IN (0, 1)")
    return fit(plain, known.where(~F.coalesce(fold("id", 5) == 0, F.lit(False))))


def _scorer(docs: DataFrame, lexicon: Lexicon):
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(scored, "double")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` without those that score 0.5 or more; its columns, whatever their names, stay as they are.

    Each row is judged by its own text, so that null or repeated ids and repeated rows stay or go as their texts do; a
    null or empty text stays; an empty table gives no row. Labels as for :func:`score_toxicity`."""
    score = _scorer(docs, learned(docs, labels, doc_id, text, label))
    return docs.where(score(text_of(text)) < 0.5)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` with held_out and score; ``labels`` has the id and the label 0 or 1.

    The lexicon is learned from labelled documents whose crc32(id) mod 5 is not 0. Defined cases: a null text
    counts as empty, and a text in which nothing matches has the same low score as the empty one; labels other
    than 0 and 1 are left out; repeated rows are scored each; without documents of both labels nothing but
    threats matches; rows without an id are scored, and aren't held out; columns of ``docs`` named held_out or score are replaced; an empty table gives no row.
    """
    held_out = F.coalesce(fold(doc_id, 5) == 0, F.lit(False))
    score = _scorer(docs, learned(docs, labels, doc_id, text, label))
    return docs.withColumns({"held_out": held_out, "score": score(text_of(text))})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
