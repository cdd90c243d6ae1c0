"""Landing of binary documents: strict decoding, snapshots, and imports by hand; what is refused keeps its reason."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators import candidates, walk
from larkspan.sources.shared import stored

_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)")
#: Which media types a file's suffix allows.
MEDIA_TYPES = {
    ".json": ("application/json", "text/json"),
    ".html": ("text/html", "application/xhtml+xml"),
    ".htm": ("text/html", "application/xhtml+xml"),
    ".csv": ("text/csv", "application/csv", "application/vnd.ms-excel"),
}
MOST_IMPORT = 2 * 1024 * 1024
#: The longest that each field of a candidate may be.
BOUNDS = {"external_id": 500, "url": 2048, "title": 500, "company": 300, "location": 500, "level": 500}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, payload, modified) of all files below a path; the reader leaves out those without a byte."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("content").alias("payload"), F.col("modificationTime").alias("modified"))


def _decoded(payload: bytes, declared: str | None) -> tuple[str | None, str | None]:
    mime = (declared or "").split(";", 1)[0].strip().lower()
    if not (mime.startswith("text/") or mime == "application/json"):
        return None, "unsupported_text_content"
    found = _CHARSET.search(declared)
    try:
        codec = codecs.lookup(found.group(1) if found else "utf-8")
        said = payload.decode(codec.name, errors="strict")
    except LookupError:
        return None, "unsupported_charset"
    except (UnicodeError, ValueError):
        return None, "invalid_text_encoding"
    return (None, "invalid_text_content") if "\x00" in said else (said, None)


def decoded(payload: Column, content_type: Column) -> Column:
    """struct(text, error) of a payload in its declared charset, UTF-8 where it names none, without replacement.

    Other than text and JSON is unsupported_text_content, an unknown charset unsupported_charset, bytes that don't fit
    invalid_text_encoding, a NUL invalid_text_content; a null payload counts as empty."""

    @F.pandas_udf("text string, error string")
    def decode(payloads: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decoded(b"" if p is None else bytes(p), k) for p, k in zip(payloads, kinds)], columns=["text", "error"], dtype=object)

    return decode(payload, content_type)


def snapshots(fetched: DataFrame, hosts: list[str], most_bytes: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) of fetched documents (url, content_type, payload, and more), from one pass.

    Accepted rows have text, raw_hash (SHA-256 of the bytes) and parse_status pending; quarantined ones their error, and
    no content. An address must be https on one of the hosts, without user, fragment or another port."""
    host = F.lower(F.regexp_extract("url", r"^https://([^/?#@:]+)(?::443)?(?:/[^#]*)$", 1))
    outside = ~F.coalesce(host.isin(*hosts), F.lit(False))
    read = fetched.withColumn("_read", decoded(F.col("payload"), F.col("content_type")))
    error = F.when(outside, "provenance_url_outside_policy").when(F.octet_length("payload") > most_bytes, "payload_too_large").otherwise(F.col("_read.error"))
    judged = stored(read.select(*fetched.columns, F.col("_read.text").alias("text"), F.sha2("payload", 256).alias("raw_hash"), error.alias("error")), "snapshots")
    accepted = judged.where("error IS NULL").drop("error", "payload").withColumn("parse_status", F.lit("pending"))
    return accepted, judged.where("error IS NOT NULL").drop("text", "payload")


def _import_error(name: str, declared: str, payload: bytes, budget: int) -> tuple[str | None, str | None, str | None]:
    """(text, media type, error) of a file imported by hand."""
    if len(payload) > min(MOST_IMPORT, budget):
        return None, None, "document_import_too_large"
    if not payload or b"\x00" in payload:
        return None, None, "document_import_invalid"
    try:
        said = payload.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None, None, "document_import_invalid"
    media = (declared or "").split(";", 1)[0].strip().casefold()
    suffix = f".{name.rpartition('.')[2].casefold()}" if "." in name.lstrip(".") else ""
    head = said.lstrip()[:1]
    if not head:
        return None, None, "document_import_invalid"
    kind = "json" if media in MEDIA_TYPES[".json"] else "html" if media in MEDIA_TYPES[".html"] else "csv"
    fits = {"json": head in ("{", "["), "html": head == "<", "csv": head not in ("<", "{", "[")}[kind]
    if media not in MEDIA_TYPES.get(suffix, ()) or not fits:
        return None, None, "document_import_type_unsupported"
    if kind == "json":
        try:
            json.loads(said)
        except (RecursionError, ValueError):
            return None, None, "document_import_invalid"
    return said, {"json": "application/json", "html": "text/html", "csv": "text/csv"}[kind], None


#: What the parser's refusals are called for an import.
_REFUSED = {"challenge_detected": "document_import_challenge_detected", "preview_content_type_unsupported": "document_import_type_unsupported", "preview_document_too_large": "document_import_too_large"}


def imported(documents: DataFrame, host: str, listing: str, item_budget: int, byte_budget: int = MOST_IMPORT, mapping: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, report) of documents (doc_id, name, content_type, payload) that are imported by hand.

    A document is taken whole or not at all: suffix, declared type and content must agree, the text be UTF-8 without
    NUL, each candidate's address be on the host and its fields within BOUNDS, and there must be one to ``item_budget``
    distinct ones by address and id. The report has (doc_id, items, coverage_complete, document_hash, error); an
    import never covers a listing."""

    @F.pandas_udf("text string, media string, error string")
    def read(names: pd.Series, kinds: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        rows = [_import_error(n or "", k or "", b"" if p is None else bytes(p), byte_budget) for n, k, p in zip(names, kinds, payloads)]
        return pd.DataFrame(rows, columns=["text", "media", "error"], dtype=object)

    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), read("name", "content_type", "payload").alias("r"), F.sha2("payload", 256).alias("document_hash"))
    judged = stored(held.select("doc_id", "r.*", "document_hash"), "imports")
    good = judged.where("error IS NULL").select("doc_id", F.col("text").alias("payload"), F.col("media").alias("content_type"), F.lit(listing).alias("base_url"))
    parsed = stored(candidates.parse_all(good, mapping), "imports-parsed")
    found = walk.new_on_page(parsed.where("error IS NULL"), "doc_id", ["place"], "url", "external_id")
    elsewhere = F.lower(F.regexp_extract("url", r"^https://([^/?#]+)", 1)) != host
    long = F.greatest(*[F.coalesce((F.length(c) > n).cast("int"), F.lit(0)) for c, n in BOUNDS.items()]) == 1
    whole = found.groupBy("doc_id").agg(F.bool_or(elsewhere).alias("elsewhere"), F.bool_or(long).alias("long"), F.count_if("fresh").alias("items"))
    refused = parsed.where("error IS NOT NULL").select("doc_id", F.coalesce(F.create_map(*[F.lit(x) for pair in _REFUSED.items() for x in pair])[F.col("error")], F.lit("document_import_invalid")).alias("refused"))
    joined = judged.join(refused, "doc_id", "left").join(whole, "doc_id", "left")
    code = F.coalesce("error", "refused", F.when(F.col("items").isNull(), "document_import_no_jobs"), F.when(F.col("elsewhere"), "document_import_route_blocked"), F.when(F.col("long") | (F.col("items") > item_budget), "document_import_invalid"))
    report = stored(joined.select("doc_id", code.alias("error"), F.when(code.isNull(), F.col("items")).otherwise(0).alias("items"), F.lit(False).alias("coverage_complete"), "document_hash"), "imports-report")
    kept = found.where("fresh").drop("fresh", "error").join(report.where("error IS NULL").select("doc_id"), "doc_id", "left_semi")
    return kept, report


def backfill(rows: DataFrame, known: DataFrame, keys: list[str], text: Column, embed, size: int, now: DataFrame | None = None, most: int | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, report) for rows whose key and hash ``known`` doesn't have.

    ``rows`` and ``known`` have the ``keys``, of which the last is the hash of what is embedded. ``embed`` takes an iterator of
    pandas Series of texts and gives one of lists of ``size`` numbers; it runs in Arrow batches, so that a model is
    loaded once a task. Its results are written before anything is judged by them. Only rows whose hash in ``now`` (the
    rows as they are after that) is still the same are given; the others are stale. Vectors of another size, or with
    a number that isn't finite, are invalid. ``most`` takes the first in ``order`` alone, as a batch of work."""
    wanted = rows.join(known.select(*keys).distinct(), keys, "left_anti")
    if most is not None:
        wanted = wanted.orderBy(order or keys[0]).limit(most)

    @F.pandas_udf("array<double>")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from embed(texts)

    made = stored(wanted.select(*keys, make(text).alias("vector")), "embedded")
    current = (rows if now is None else now).select(*keys).distinct().withColumn("_current", F.lit(True))
    judged = made.join(current, keys, "left")
    sound = (F.size("vector") == size) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    outcome = F.when(~F.coalesce(sound, F.lit(False)), "invalid").when(F.col("_current"), "created").otherwise("stale")
    told = stored(judged.withColumn("outcome", outcome).drop("_current"), "embedded-judged")
    hits = rows.join(known.select(*keys).distinct(), keys, "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    counts = told.agg(F.count(F.lit(1)).alias("selected"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "stale", "invalid")])
    # one row each
    return told.where("outcome = 'created'").drop("outcome"), counts.crossJoin(hits)
