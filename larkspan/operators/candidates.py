"""Job candidates from landed HTML, JSON and CSV documents."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.functions.jobs import challenged
from larkspan.operators import nodes as tree
from larkspan.sources.shared import stored

MOST_BYTES = 10_000_000
MOST_ROWS, MOST_COLUMNS, MOST_CELL = 500, 64, 65_536
#: JSON values deeper than so much are not looked into.
MOST_NESTED = 500
#: The names under which a record may have each field; the first that is there counts, even with null.
FIELDS = {
    "title": ("title", "name"),
    "company": ("company", "company_name", "employer"),
    "url": ("url", "jobUrl", "job_url", "link", "absolute_url"),
    "external_id": ("id", "externalId", "external_id"),
    "location": ("location", "location_name"),
    "level": ("level", "level_raw", "seniority"),
    "description": ("description", "description_text"),
    "posted_at": ("datePosted", "postedAt", "posted_at"),
}
#: Where a posting has them otherwise.
INSIDE = {"company": ("hiringOrganization", "name"), "external_id": ("identifier", "value"), "location": ("jobLocation", "address", "addressLocality")}
SCHEMA = (
    "doc_id long, place int, method string, title string, company string, url string, external_id string, location string, level string, description string, "
    "posted_at string, confidence double, provenance array<struct<field:string,path:string,method:string>>, warnings array<string>"
)
#: What a row of the parsers holds besides, for documents that are refused.
PARSED = f"{SCHEMA}, error string"
CONFIDENCE = {"structured_data": 0.94, "structured_json": 0.90, "structured_csv": 0.90, "page_field": 0.82, "manual_mapping": 0.86}
_COLUMNS = ["doc_id", "place", "method", *FIELDS, "confidence", "provenance", "warnings", "error"]
_ORDER = ["title", "company", "url", "external_id", "location", "level", "description", "posted_at"]
_REQUIRED = frozenset(_ORDER[:4])
JSON_TYPES, HTML_TYPES = ("application/json", "application/ld+json", "text/json"), ("text/html", "application/xhtml+xml")
_ANY_TAG = re.compile(r"(?is)</?[a-z][a-z0-9:-]*(?:\s[^<>]*)?/?>|<!--|<!doctype\s")


class _Refused(Exception):
    """A document that is refused as a whole, with its code."""


def _plain(value) -> str | None:
    """A scalar's text, white space collapsed."""
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    return " ".join(str(value).split()) or None


def _description(value) -> str | None:
    """A scalar's text by lines; of HTML its structured text."""
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    return text.plain_html(str(value)) if _ANY_TAG.search(str(value)) else text.plain_lines(str(value))


def _inside(record, path: tuple[str, ...]):
    """What lies at the path, through the first entry of a list."""
    for name in path:
        record = record[0] if isinstance(record, list) and record else record
        record = record.get(name) if isinstance(record, dict) else None
    return record


def canonical_job_url(value, base: str | None) -> str | None:
    """An https address without fragment, resolved against the base; null if it has a user or a port, or isn't one."""
    said = _plain(value)
    if said is None:
        return None
    try:
        parts = urlsplit(urljoin(base or "", said))
        port = parts.port
    except ValueError:
        return None
    if parts.scheme.casefold() != "https" or not parts.hostname or port is not None or parts.username is not None or parts.password is not None:
        return None
    return urlunsplit(("https", parts.hostname.casefold(), parts.path or "/", parts.query, ""))


def _candidate(record: Mapping, base: str, method: str, path: str, place: int) -> dict | None:
    """The candidate of a record that has a title, a company and a usable address; its host may be any, as routes are
    judged later. Each field tells where it comes from, each optional one that isn't there is a warning."""
    raw = {field: next((record[n] for n in names if n in record), None) for field, names in FIELDS.items()}
    raw |= {field: _inside(record, where) for field, where in INSIDE.items() if raw[field] is None}
    found = {field: _plain(v) for field, v in raw.items()}
    if found["external_id"] is None:
        found["external_id"] = _plain(_inside(record, INSIDE["external_id"]))
    found["description"] = _description(raw["description"])
    found["url"] = canonical_job_url(raw["url"], base)
    if not (found["title"] and found["company"] and found["url"]):
        return None
    found["external_id"] = found["external_id"] or hashlib.sha256(found["url"].encode("utf-8", "surrogatepass")).hexdigest()
    return found | {
        "place": place,
        "method": method,
        "confidence": CONFIDENCE[method],
        "provenance": [{"field": f, "path": f"{path}.{f}", "method": method} for f in _ORDER if found[f] is not None],
        "warnings": [f"missing_optional:{f}" for f in _ORDER if f not in _REQUIRED and found[f] is None],
    }


def _records(value, depth: int = 0) -> Iterator[dict]:
    """Job records anywhere in a JSON value: postings, the elements of item lists, objects under ``jobs``."""
    if depth > MOST_NESTED:
        return
    if isinstance(value, list):
        for item in value:
            yield from _records(item, depth + 1)
    elif isinstance(value, dict):
        kind = value.get("@type")
        if kind == "JobPosting":
            yield value
        elif kind == "ItemList" and isinstance(value.get("itemListElement"), list):
            for element in value["itemListElement"]:
                inner = element.get("item") if isinstance(element, dict) else None
                yield from _records(inner if isinstance(inner, dict) else element, depth + 1)
        elif isinstance(value.get("jobs"), list):
            yield from (j for j in value["jobs"] if isinstance(j, dict))
        else:
            for item in value.values():
                yield from _records(item, depth + 1)


def _from_json(payload: str, base: str, method: str = "structured_json", path: str = "json") -> list[dict]:
    try:
        document = json.loads(payload)
    except (ValueError, RecursionError):  # malformed, or deeper than the reader goes
        return []
    return [c for i, r in enumerate(_records(document)) if (c := _candidate(r, base, method, f"{path}[{i}]", i))]


def _from_csv(payload: str, base: str) -> list[dict]:
    csv.field_size_limit(MOST_BYTES)
    try:
        rows = [r for r in csv.reader(io.StringIO(payload, newline=""), strict=True) if r]
    except csv.Error:
        raise _Refused("preview_csv_invalid") from None
    if not rows or len(rows) > MOST_ROWS + 1 or len(rows[0]) > MOST_COLUMNS or not all(rows[0]):
        raise _Refused("preview_csv_invalid")
    if any(len(r) != len(rows[0]) or any(len(c) > MOST_CELL for c in r) for r in rows):
        raise _Refused("preview_csv_invalid")
    return [c for i, r in enumerate(rows[1:]) if (c := _candidate(dict(zip(rows[0], r)), base, "structured_csv", f"csv.row[{i + 1}]", i))]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in _COLUMNS] for r in rows], columns=_COLUMNS, dtype=object).astype({"place": "Int32"})


def _mime(column: str = "content_type") -> Column:
    return F.lower(F.trim(F.substring_index(column, ";", 1)))


def _structured(docs: DataFrame, parser: Callable[[str, str], list[dict]]) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for key, payload, base in zip(batch["doc_id"], batch["payload"], batch["base_url"]):
                try:
                    rows += [{"doc_id": key, **c} for c in parser(payload, base)]
                except _Refused as refused:
                    rows.append({"doc_id": key, "error": str(refused)})
            yield _frame(rows)

    return docs.select("doc_id", "payload", "base_url").mapInPandas(parse, PARSED)


#: Where the fields of a semantic card are looked for; the later signatures where no node has the first.
_CARD_FIELDS = {
    "title": (("title", "job-title"), ("h1", "h2", "h3")),
    "company": (("company", "employer", "company-name"), ()),
    "url": (("job-link",), ("a",)),
    "location": (("location", "job-location"), ()),
    "level": (("level", "seniority", "job-level"), ()),
}


def _semantic_cards(page_nodes: DataFrame) -> DataFrame:
    both = F.array_contains("classes", "job") & F.array_contains("classes", "card")
    card = F.array_contains("classes", "job-card") | both | F.coalesce(F.lower(tree.attr("itemtype")).endswith("jobposting"), F.lit(False))
    fields = {f"{name}_class": tree.has_class(*classes) for name, (classes, _) in _CARD_FIELDS.items()}
    fields |= {f"{name}_tag": F.col("tag").isin(*tags) for name, (_, tags) in _CARD_FIELDS.items() if tags}
    found = tree.first_inside(page_nodes, card, fields)
    chosen = {n: F.coalesce(*[f"{n}_{k}" for k in ("class", "tag") if f"{n}_{k}" in fields]) for n in _CARD_FIELDS}
    whole = chosen["title"].isNotNull() & chosen["company"].isNotNull() & chosen["url"].isNotNull()
    return found.where(whole).select("doc_id", F.col("node").alias("card"), tree.attr("data-job-id").alias("id"), *[c.alias(n) for n, c in chosen.items()])


def _mapped_cards(page_nodes: DataFrame, mapping: Mapping) -> DataFrame:
    names = {"title": "title", "company": "company", "location": "location", "level": "level", "url": "job_url"}
    found = tree.first_inside(page_nodes, tree.signature(mapping.get("card")), {n: tree.signature(mapping.get(m)) for n, m in names.items()})
    return found.select("doc_id", F.col("node").alias("card"), tree.attr("data-job-id").alias("id"), *names)


def _from_cards(cards: DataFrame, page_nodes: DataFrame, bases: DataFrame, method: str, path: str) -> DataFrame:
    """The candidates of cards (doc_id, card, id, and the node of each field)."""
    fields = [F.struct(F.lit(n).alias("field"), F.col(n).alias("node")) for n in _CARD_FIELDS]
    each = cards.select("doc_id", "card", "id", F.inline(F.array(*fields))).where("node IS NOT NULL")
    links = each.where("field = 'url'").join(page_nodes.select("doc_id", "node", tree.attr("href").alias("said")), ["doc_id", "node"])
    words = each.where("field <> 'url'")
    told = words.join(tree.inner_texts(page_nodes, words.select("doc_id", "node")).withColumnRenamed("text", "said"), ["doc_id", "node"])
    shown = told.select("doc_id", "card", "id", "field", "said").unionByName(links.select("doc_id", "card", "id", "field", "said"))
    # five fields a card at most
    records = shown.groupBy("doc_id", "card").agg(F.first("id").alias("id"), *[F.max(F.when(F.col("field") == n, F.col("said"))).alias(n) for n in _CARD_FIELDS])
    columns = ["id", *_CARD_FIELDS]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for key, card, base, *values in zip(batch["doc_id"], batch["card"], batch["base_url"], *[batch[c] for c in columns]):
                record = {n: None if v is None or v is pd.NA else v for n, v in zip(columns, values)}
                if found := _candidate(record, base, method, f"{path}[{card}]", int(card)):
                    made.append({"doc_id": key, **found})
            yield _frame(made)

    return records.join(bases, "doc_id").mapInPandas(parse, PARSED)


def _from_scripts(page_nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """The candidates of each page's first JSON-LD script that has any; a page's scripts go into one row."""
    wanted = (F.col("tag") == "script") & (F.lower(tree.attr("type")) == "application/ld+json")
    scripts = page_nodes.where(wanted).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node", F.array_join("parts", "").alias("said")))).alias("scripts"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list[dict] = []
            for key, said, base in zip(batch["doc_id"], batch["scripts"], batch["base_url"]):
                found = next((c for script in said if (c := _from_json(script["said"], base, "structured_data", "jsonld"))), [])
                made += [{"doc_id": key, **c} for c in found]
            yield _frame(made)

    return scripts.join(bases, "doc_id").mapInPandas(parse, PARSED)


def parse_all(docs: DataFrame, mapping: Mapping | None = None, bounded: bool = True) -> DataFrame:
    """Rows of PARSED: the candidates of documents (doc_id, payload, content_type, base_url), each id once; and one row
    with an error for each document that is refused.

    Refused are documents that are too large, that ask for proof of a human reader, of another type, with CSV that
    isn't strict or too large, or HTML that is too complex. Of HTML the first JSON-LD script with candidates goes
    before job cards, these before the cards of the ``mapping``. A record that can't be read is left out, whatever is in
    it, and the others stay. Null payloads count as empty. Where it isn't ``bounded``, no document is too large, no page
    too complex, and none counts as asking for proof."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("payload", F.lit("")).alias("payload"), _mime().alias("mime"), "base_url")
    code = F.when(F.lit(bounded) & (F.octet_length("payload") > MOST_BYTES), "preview_document_too_large").when(F.lit(bounded) & challenged(F.col("payload")), "challenge_detected")
    code = code.when(F.coalesce(~F.col("mime").isin(*JSON_TYPES, *HTML_TYPES, "text/csv"), F.lit(True)), "preview_content_type_unsupported")
    judged = held.withColumn("refused", code)
    open_docs = judged.where("refused IS NULL")
    of = lambda *types: open_docs.where(F.col("mime").isin(*types))
    pages, bases = of(*HTML_TYPES), of(*HTML_TYPES).select("doc_id", "base_url")
    elements = stored(tree.page_nodes(pages, html="payload", bounded=bounded), "nodes")
    found = [stored(_from_scripts(elements, bases), "scripts")]
    makers = [("page_field", "html.card", _semantic_cards)]
    if mapping:
        makers.append(("manual_mapping", "mapping.card", lambda left: _mapped_cards(left, mapping)))
    left = elements
    for method, path, cards in makers:
        # what an earlier way has found isn't looked for in another
        left = left.join(found[-1].select("doc_id").distinct(), "doc_id", "left_anti")
        found.append(stored(_from_cards(cards(left), left, bases, method, path), "cards"))
    blank = lambda df, code: df.select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found[0].schema.fields[1:-1]], code.alias("error"))
    parts = [
        _structured(of(*JSON_TYPES), _from_json), _structured(of("text/csv"), _from_csv), *found,
        blank(judged.where("refused IS NOT NULL"), F.col("refused")), blank(elements.where("error IS NOT NULL"), F.col("error")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parse_documents(docs: DataFrame, mapping: Mapping | None = None, bounded: bool = True) -> DataFrame:
    """Rows of SCHEMA, one for each candidate; refused documents give none, as :func:`parse_all` tells."""
    return parse_all(docs, mapping, bounded).where("error IS NULL").drop("error")


def pagination_targets(pages: DataFrame, mapping: Mapping | None = None, most: int = 5, bounded: bool = True) -> DataFrame:
    """Rows (doc_id, targets, error) of pages (doc_id, html, base_url): where their next or load-more controls lead.

    Controls are nodes with rel next, a class or a label for it, or those that fit the mapping's ``control``. The first
    ``most`` distinct usable targets count, in order. A control without a target that isn't disabled and comes before
    the last of these is an unsupported_interaction, as is a page that can't be parsed an error of its own. Where it isn't
    ``bounded``, no page is too complex."""
    elements = stored(tree.page_nodes(pages, bounded=bounded), "nodes")
    tokens = F.split(F.lower(F.coalesce(tree.attr("rel"), F.lit(""))), r"\s+")
    semantic = F.array_contains(tokens, "next") | tree.has_class("next", "pagination-next", "load-more") | F.lower(tree.attr("aria-label")).isin("next", "load more")
    control = F.coalesce(semantic, F.lit(False)) | tree.signature((mapping or {}).get("control"))
    said = F.coalesce(*[F.when(tree.attr(n) != "", tree.attr(n)) for n in ("href", "data-url", "data-next-url")])
    disabled = F.map_contains_key("attrs", "disabled") | F.coalesce(F.lower(tree.attr("aria-disabled")) == "true", F.lit(False))

    @F.pandas_udf("string")
    def resolved(targets: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([canonical_job_url(t, b) for t, b in zip(targets, bases)], dtype="object")

    bases = pages.select(F.col("doc_id").cast("long").alias("doc_id"), "base_url")
    controls = elements.where("error IS NULL").where(control).withColumn("said", said).where(F.col("said").isNotNull() | ~disabled)
    led = controls.join(bases, "doc_id").withColumn("target", F.when(F.col("said").isNotNull(), resolved("said", "base_url"))).select("doc_id", "node", "said", "target")
    # the first place of each target, then the first targets, of which a window keeps ``most``
    usable = led.where("target IS NOT NULL").groupBy("doc_id", "target").agg(F.min("node").alias("node"))
    ranked = usable.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("node"))).where(F.col("rank") <= most)
    targets = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "target"))), lambda t: t["target"]).alias("targets"), F.max(F.when(F.col("rank") == most, F.col("node"))).alias("full"))
    dead = led.where("said IS NULL").groupBy("doc_id").agg(F.min("node").alias("dead"))
    broken = elements.where("error IS NOT NULL").select("doc_id", F.col("error").alias("broken"))
    whole = bases.select("doc_id").join(targets, "doc_id", "left").join(dead, "doc_id", "left").join(broken, "doc_id", "left")
    stopped = F.col("dead").isNotNull() & (F.col("full").isNull() | (F.col("dead") < F.col("full")))
    error = F.coalesce("broken", F.when(stopped, "unsupported_interaction"))
    return whole.select("doc_id", F.when(error.isNull(), F.coalesce("targets", F.array().cast("array<string>"))).alias("targets"), error.alias("error"))
