"""Exact Jaccard join of shingle sets by token-combination prefixes.

A set's tokens are put in one global order, rare ones first. Two sets of which the Jaccard similarity is at least
t share at least k of the first ``n - ceil(t * n) + k`` tokens of each. If one of those they share is rare, they
meet at that single token. If all are frequent, they are dealt to k - 1 groups by hash, so that two of them fall in
one group: they meet at that pair. A token that one set alone has is never sent beyond the count of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import shuffle_partitions, stored, text_of, version, without
from larkspan.llm.components import components
from larkspan.llm.shingles import mix, shingle_sets, signature

_U = np.uint64
#: Similarity as a share of 100.
LEAST = 80
#: Tokens in at least 2 ** (RARE / 4) sets are frequent.
RARE = 24
#: Bytes of a token in a parcel, from the top of its hash.
TOKEN = 6
#: Tokens that one task counts.
TASK_TOKENS = 2_000_000
#: Tokens that travel in one row's worth of parcels.
PARCEL = 700_000
#: Tokens in about so many sets are hot, by an estimate from one text in SAMPLED; MOST_HOT of them at most.
HOT, SAMPLED, MOST_HOT = 10_000, 16, 1 << 20


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN]).tobytes()


def _unpack(parcel: bytes) -> np.ndarray:
    out = np.zeros((len(parcel) // TOKEN, 8), np.uint8)
    out[:, :TOKEN] = np.frombuffer(parcel, np.uint8).reshape(-1, TOKEN)
    return out.reshape(-1).view("<u8")


KEYED = "key long, sig long, n long, shared long, central double"


def document_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (id, v, n, sig): the text's version, the size of each document's set, and the hash that equal sets share."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), version(text).alias("v"), text_of(text).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [(len(s), signature(s)) for s in shingle_sets(batch["text"])]
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "n": [n for n, _ in sets], "sig": [s for _, s in sets]})

    return rows.mapInPandas(scan, f"id {rows.schema['id'].dataType.simpleString()}, v long, n long, sig long")


_PARCELS = "bucket int, sigs binary, sizes binary, counts binary, tokens binary, extra binary"


def _parcels(buckets: np.ndarray, n: int, sigs: np.ndarray, sizes: np.ndarray, owner: np.ndarray, tokens: np.ndarray, extra: np.ndarray | None) -> Iterator[tuple]:
    """The tokens of each bucket in one row; within it by owner. ``owner`` is an index into sigs and sizes."""
    order = np.lexsort((owner, buckets))
    buckets, owner, tokens, extra = buckets[order], owner[order], tokens[order], None if extra is None else extra[order]
    bounds = np.searchsorted(buckets, np.arange(n + 1))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            own, counts = np.unique(owner[a:b], return_counts=True)
            yield k, sigs[own].tobytes(), sizes[own].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), _pack(tokens[a:b]), b"" if extra is None else extra[a:b].tobytes()


def _opened(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sigs, their sizes, and for each token its owner (an index into sigs), the token and its extra byte.

    A set that came in more than one parcel of the bucket with the same tokens counts once."""
    joined = lambda c, kind: np.frombuffer(b"".join(group[c]), kind)
    sigs, sizes, counts = joined("sigs", "<i8"), joined("sizes", "<u4"), joined("counts", "<u4")
    return sigs, sizes, np.repeat(np.arange(len(sigs)), counts), _unpack(b"".join(group["tokens"])), joined("extra", np.uint8)


def frequency_class(times: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(4 * np.log2(np.maximum(times, 1))), 255).astype(np.uint8)


def _repeated_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tokens that several sets of a batch have; equal sets count once."""
    for batch in batches:
        sets = {signature(s): s for s in shingle_sets(batch["text"]) if len(s)}
        if sets:
            tokens, times = np.unique(np.concatenate(list(sets.values())) >> _U(64 - 8 * TOKEN), return_counts=True)
            yield pd.DataFrame({"token": tokens[times > 1].astype(np.int64), "times": times[times > 1]})


def hot_tokens(texts: DataFrame, least: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens so frequent that the sets which have one shouldn't meet in a task, and their frequency classes.

    This decides where tokens travel, never which sets are compared: any list gives the same links, as every task
    has the same. So it is estimated from one text in SAMPLED, and ``least`` is doubled until MOST_HOT suffice."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInPandas(_repeated_tokens, "token long, times long")
    counted = stored(some.groupBy("token").agg((F.sum("times") * SAMPLED).alias("times")).where(F.col("times") >= least), "jaccard-hot")
    while counted.where(F.col("times") >= least).count() > MOST_HOT:
        least *= 2
    found = counted.where(F.col("times") >= least).orderBy("token").toPandas()
    return found["token"].to_numpy(np.int64).astype(_U), frequency_class(found["times"].to_numpy(np.float64))


def _send_tokens(n: int, hot):
    """Each token to the task that counts it; a set's hot tokens, of which the class is known, by way of any task."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, classes = hot.value
        seen: set[int] = set()
        held = 0
        sets: list[np.ndarray] = []
        sigs: list[int] = []

        def flush() -> pd.DataFrame:
            tokens = np.concatenate(sets) >> _U(64 - 8 * TOKEN)
            sizes, names = np.array([len(s) for s in sets]), np.array(sigs, "<i8")
            owner = np.repeat(np.arange(len(sets)), sizes)
            rows, is_hot = [], np.zeros(len(tokens), bool)
            if len(known):
                place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                is_hot = known[place] == tokens
                via = np.full(int(is_hot.sum()), abs(int(names[0])) % n)
                rows += _parcels(via, n, names, sizes, owner[is_hot], tokens[is_hot], classes[place[is_hot]])
            rows += _parcels((tokens[~is_hot] % _U(n)).astype(np.int64), n, names, sizes, owner[~is_hot], tokens[~is_hot], None)
            sets.clear()
            sigs.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _PARCELS.split(", ")])

        for batch in batches:
            for s in shingle_sets(batch["text"]):
                if len(s) and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    sets.append(s)
                    sigs.append(sig)
                    held += len(s)
                    if held >= PARCEL:
                        held = 0
                        yield flush()
        if sets:
            yield flush()

    return send


def _count_tokens(n: int):
    """The tokens that two sets or more have, each with its frequency class, to where their set is put together."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        is_hot = group["extra"].map(len) > 0
        parts = [_opened(group[is_hot])]
        sigs, sizes, owner, tokens, _ = _opened(group[~is_hot])
        _, first, same = np.unique(sigs, return_index=True, return_inverse=True)
        fresh = (first[same] == np.arange(len(sigs)))[owner]  # copies of a set from other tasks go
        owner, tokens = owner[fresh], tokens[fresh]
        order = np.argsort(tokens, kind="stable")
        owner, tokens = owner[order], tokens[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
        df = np.diff(np.append(starts, len(tokens)))
        each = np.repeat(df, df)
        keep = each > 1
        parts.append((sigs, sizes, owner[keep], tokens[keep], frequency_class(each[keep])))
        rows = []
        for sigs, sizes, owner, tokens, classes in parts:
            home = (mix(sigs.astype(_U)) % _U(n)).astype(np.int64)[owner]
            rows += _parcels(home, n, sigs, sizes, owner, tokens, classes)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PARCELS.split(", ")])

    return count


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    """Each set's shared tokens in the global order, if they are enough for a partner."""
    sigs, sizes, owner, tokens, classes = _opened(group)
    own, index, place = np.unique(sigs, return_index=True, return_inverse=True)
    owner = place[owner]
    size = sizes[index].astype(np.int64)
    order = np.lexsort((tokens, classes, owner))
    owner, tokens, classes = owner[order], tokens[order], classes[order]
    # hot tokens of equal sets come from each of their tasks
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])])[: len(owner)]
    owner, tokens, classes = owner[fresh], tokens[fresh], classes[fresh]
    shared = np.bincount(owner, minlength=len(own))
    bounds = np.concatenate([[0], np.cumsum(shared)])
    rows = []
    for k in np.flatnonzero(100 * shared >= LEAST * size):
        a, b = bounds[k], bounds[k + 1]
        rows.append((own[k], size[k], shared[k], int(np.searchsorted(classes[a:b], RARE)), float(classes[a:b].sum() / size[k]), tokens[a:b].astype("<u8").tobytes()))
    return pd.DataFrame(rows, columns=["sig", "n", "shared", "rare", "central", "tokens"])


def set_keys(n: int, tokens: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys at which a set meets its partners, at single tokens and at pairs, from its shared tokens in the
    global order, ``rare`` first."""
    alone = n - len(tokens)
    need = -(-LEAST * n // 100)
    own = n.bit_length() - 1
    sizes = {own, (n * 100 // LEAST).bit_length() - 1}  # a partner may be of the next size class
    pairs = [np.zeros(0, _U)]
    most = 0
    for size in sizes:
        groups = max(1, (1 << size) >> 3)
        reach = min(n, n - need + groups + 1) - alone
        most = max(most, reach)
        often = np.sort(tokens[rare:reach]) if reach > rare else tokens[:0]
        dealt = (mix(often) % _U(groups)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        often, dealt = often[order], dealt[order]
        for gap in range(1, len(often)):
            same = dealt[gap:] == dealt[:-gap]
            if not same.any():
                break
            pairs.append(mix(often[:-gap][same] * _U(0x9E3779B97F4A7C15) + mix(often[gap:][same] + _U(size))))
    return mix(tokens[: max(0, min(most, rare))]), np.unique(np.concatenate(pairs))


def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``shared`` is what a partner met at this key can share at most. A set has keys of pairs only if all its rare
    tokens are keys, so that partners which meet at pairs alone share none of them."""
    for batch in batches:
        for sig, n, shared, rare, central, tokens in zip(*(batch[c] for c in ("sig", "n", "shared", "rare", "central", "tokens"))):
            single, pairs = set_keys(int(n), np.frombuffer(tokens, "<u8"), int(rare))
            if len(single) + len(pairs):
                most = np.repeat([shared, shared - rare], [len(single), len(pairs)])
                yield pd.DataFrame({"key": np.concatenate([single, pairs]).astype(np.int64), "sig": sig, "n": n, "shared": most, "central": central})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        common = np.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(batch["x"], batch["y"])], np.int64)
        linked = 100 * common >= LEAST * (batch["na"].to_numpy() + batch["nb"].to_numpy() - common)
        yield batch.loc[linked, ["a", "b"]]


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are similar enough."""
    of = lambda end, tokens: sets.select(F.col("sig").alias(end), F.col("n").alias(f"n{end}"), F.col("tokens").alias(tokens))
    return pairs.join(of("b", "y"), "b").join(of("a", "x"), "a").mapInPandas(_verified, "a long, b long")


def _may_link(x: str, y: str, prefix: str = ""):
    """What sizes and shared tokens allow: the overlap is at most the smaller number of shared tokens."""
    least = F.least(f"{x}.shared", f"{y}.{prefix}shared")
    return (100 + LEAST) * least >= LEAST * (F.col(f"{x}.n") + F.col(f"{y}.{prefix}n"))


def similar_sets(docs: DataFrame, text: str, total: int, hot: int = HOT) -> DataFrame:
    """Rows (node, label): the components of the distinct sets (by sig) that have a partner."""
    n = max(1, shuffle_partitions(docs.sparkSession), total // TASK_TOKENS)
    texts = docs.select(text_of(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(hot_tokens(texts, hot))
    parcels = texts.mapInPandas(_send_tokens(n, known), _PARCELS)
    counted = parcels.groupBy("bucket").applyInPandas(_count_tokens(n), _PARCELS)
    sets = stored(counted.groupBy("bucket").applyInPandas(_gather, "sig long, n long, shared long, rare long, central double, tokens binary"), "jaccard-sets")
    return meet(sets.mapInPandas(keys_of, KEYED), sets)


def meet(keyed: DataFrame, sets: DataFrame, keyed_again: DataFrame | None = None) -> DataFrame:
    """Rows (node, label): components of the sets (sig, n, tokens) that meet at a key of ``keyed`` and are similar.

    ``keyed`` has (key, sig, n, shared, central): the set's size, how many of its tokens any other set has, and how
    common they are. Candidates are found in two steps. First each set is held against the most central set that
    it meets; then the components so far are held against each other wherever they still meet, so that no link
    between different components is missed, while sets that are connected already aren't paired again."""
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.max(F.struct("central", "sig", "n", "shared")).alias("hub")).where("sets > 1")
    keys = stored(keyed.join(met, "key").drop("sets"), "jaccard-keys")
    chosen = (
        keys.alias("k").where((F.col("hub.sig") != F.col("sig")) & _may_link("k", "hub"))
        .groupBy("sig", F.col("hub.sig").alias("hub")).agg(F.count(F.lit(1)).alias("meetings"))
        .groupBy("sig").agg(F.max(F.struct("meetings", "hub")).alias("best"))
    )
    first = stored(_links(chosen.select(F.col("best.hub").alias("a"), F.col("sig").alias("b")), sets), "jaccard-links")
    found = components(first)

    again = keys.drop("hub") if keyed_again is None else keyed_again
    labelled = stored(again.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig")), "jaccard-labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    still = stored(labelled.join(open_keys, "key", "left_semi"), "jaccard-open")
    # by size too, so that the bound is as sharp for what a component has at a key as for its members
    heads = still.groupBy("key", "label", "n").agg(F.max("shared").alias("shared"))
    x, y = heads.alias("x"), heads.select(*[F.col(c).alias(f"other_{c}") for c in heads.columns]).alias("y")
    meeting = x.join(y, (F.col("key") == F.col("other_key")) & (F.col("label") < F.col("other_label")) & _may_link("x", "y", "other_"))
    first_ends = still.alias("m").join(
        meeting.select("key", "label", "n", "other_label", "other_n", "other_shared").alias("h"),
        (F.col("m.key") == F.col("h.key")) & (F.col("m.label") == F.col("h.label")) & (F.col("m.n") == F.col("h.n")) & ((100 + LEAST) * F.least("m.shared", "other_shared") >= LEAST * (F.col("m.n") + F.col("other_n"))),
    ).select("m.*", "other_label", "other_n")
    x, y = first_ends.alias("x"), still.alias("y")
    pairs = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("other_label") == F.col("y.label")) & (F.col("other_n") == F.col("y.n")) & _may_link("x", "y"))
        .select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
    )
    second = _links(pairs, sets)
    return components(first.unionByName(second))


def _labelled(docs: DataFrame, doc_id: str, text: str, hot: int = HOT) -> DataFrame:
    """Rows (id, v, n, least) of all documents: ``least`` is the smallest id that links reach, if any is."""
    each = stored(document_sets(docs, doc_id, text), "jaccard-documents")
    total = each.agg(F.sum("n")).first()[0] or 0
    found = similar_sets(docs, text, total, hot).withColumnRenamed("node", "sig")
    labelled = each.join(found, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = labelled.where("n > 0").groupBy("label").agg(F.min("id").alias("least"))
    return labelled.join(least, "label", "left").select("id", "v", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("least"))


def linked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of all documents.

    Documents link when the Jaccard similarity of their sets of five-word shingles is at least 0.8; component_id
    is the smallest id that links reach. Shingles are compared by 48 bits of a hash, and equal sets known by 64: of N
    pairs of sets with n shingles each that are compared, about N * n * n / 2 ** 48 share a shingle too many, and of M
    sets M * M / 2 ** 65 pairs count as equal, less than one pair in 10 ** 9 sets. Defined cases: a null text, or one
    without words, has an empty set and is linked with nothing; one of fewer than five words has its whole sequence of
    words as its only shingle; documents with equal sets are one node here, however many they are; a repeated row is
    one more document with its id, and rows of one id with different texts are documents of their own; a null id is
    the smallest only where no other is reached; other columns are ignored; an empty table gives no row.
    """
    return _labelled(docs, doc_id, text, hot).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def drop_linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that links join to one with a smaller id; its columns stay as they are.

    Defined cases as for :func:`linked_documents`: of rows of one id only those go whose own text is linked so, a null
    id goes if its text reaches another, and rows that repeat the one that stays stay too."""
    found = _labelled(docs, doc_id, text)
    return without(docs, found.where(~F.col("id").eqNullSafe(F.col("least"))), doc_id, text)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), t AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT x, y FROM p UNION SELECT y, x FROM p
), r(doc_id, reached) AS (
  SELECT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
), m AS (
  SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id
)
SELECT doc_id, len(s.s) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM s LEFT JOIN m USING (doc_id)
"""
