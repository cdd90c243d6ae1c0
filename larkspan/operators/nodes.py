"""Pages as tables of nodes: one row for each element, with the interval of its descendants."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_NODES, MOST_DEPTH = 50_000, 256
#: Elements without content.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source"})
SCHEMA = "doc_id long, node int, parent int, last int, depth int, tag string, classes array<string>, attrs map<string,string>, parts array<string>, error string"
_COLUMNS = [c.split()[0] for c in SCHEMA.replace("string,string", "").split(", ")]


class _TooComplex(Exception):
    pass


class _Tree(HTMLParser):
    """Elements in document order. An end tag closes its nearest open element and all inside; one without is ignored."""

    def __init__(self, bounded: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.bounded = bounded
        self.rows: list[list] = []
        self.open: list[int] = []
        self.tags: Counter[str] = Counter()  # of the open elements

    def handle_starttag(self, tag, attrs):
        if self.bounded and (len(self.rows) >= MOST_NODES or len(self.open) >= MOST_DEPTH):
            raise _TooComplex
        node, given = len(self.rows), {k.casefold(): v or "" for k, v in attrs}
        classes = sorted(set(given.get("class", "").casefold().split()))
        self.rows.append([node, self.open[-1] if self.open else None, node, len(self.open), tag.casefold(), classes, given, []])
        if tag.casefold() not in VOID:
            self.open.append(node)
            self.tags[tag.casefold()] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag.casefold() not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        # looked for only where there is one, so that all that is passed is closed
        if self.tags[tag.casefold()]:
            self._close(next(i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]][4] == tag.casefold()))

    def _close(self, at: int) -> None:
        for node in self.open[at:]:
            self.rows[node][2] = len(self.rows) - 1
            self.tags[self.rows[node][4]] -= 1
        del self.open[at:]

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]][7].append(data)


def tree(page: str, bounded: bool = True) -> tuple[list[list], str | None]:
    """The elements of a page as rows (node, parent, last, depth, tag, classes, attrs, parts), or what is wrong with it."""
    parser = _Tree(bounded)
    try:
        parser.feed(page)
        parser.close()
    except _TooComplex:
        return [], "preview_document_too_complex"
    except Exception:  # whatever the parser doesn't read: one bad page is one row
        return [], "preview_html_invalid"
    parser._close(0)
    return parser.rows, None


def page_nodes(pages: DataFrame, doc_id: str = "doc_id", html: str = "html", bounded: bool = True) -> DataFrame:
    """Rows of SCHEMA for all elements of all pages, in one pass without a shuffle.

    Elements are numbered from 0 in document order, so that the descendants of one are those from ``node`` + 1 to
    ``last``. ``parts`` are the texts that lie directly in it. A page of more than MOST_NODES elements or deeper than
    MOST_DEPTH, or one that can't be read, gives a single row with its error; a null or empty page gives none. Where it
    isn't ``bounded``, no page is too large or too deep."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[list] = []
            for key, page in zip(batch["doc_id"], batch["html"]):
                found, error = tree(page or "", bounded)
                rows += [[key, *r, None] for r in found] if error is None else [[key, *[None] * 8, error]]
                while len(rows) >= MOST_NODES:
                    yield _frame(rows[:MOST_NODES])
                    rows = rows[MOST_NODES:]
            yield _frame(rows)

    return pages.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{html}`").alias("html")).mapInPandas(parse, SCHEMA)


def _frame(rows: list[list]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return frame.astype({c: "Int32" for c in ("node", "parent", "last", "depth")})


def has_class(*names: str) -> Column:
    """Whether a node has one of the classes."""
    return F.arrays_overlap("classes", F.array(*map(F.lit, names)))


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def signature(said: Mapping | None) -> Column:
    """Whether a node fits a signature: its ``tag``, and all of its ``class_tokens``; one of them must be given."""
    said = said if isinstance(said, Mapping) else {}
    tag, tokens = said.get("tag"), said.get("class_tokens")
    if tokens is not None and not (isinstance(tokens, list) and all(isinstance(t, str) for t in tokens)):
        return F.lit(False)
    if tag is None and tokens is None:
        return F.lit(False)
    fits = [] if tag is None else [F.col("tag") == F.lit(tag)]
    fits += [F.array_contains("classes", t) for t in tokens or ()]
    return F.coalesce(reduce(Column.__and__, fits, F.lit(True)), F.lit(False))


def first_inside(nodes: DataFrame, card: Column, fields: Mapping[str, Column]) -> DataFrame:
    """The nodes that fit ``card``, with the number of the first descendant that fits each field; null if none does.

    The next node that fits, in document order, is a descendant if it isn't past the card's last one: one window over
    each page's nodes, from its end, so that each node is added to the frame once, and no pairs of nodes."""
    ahead = Window.partitionBy("doc_id").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    following = {name: F.last(F.when(fits, F.col("node")), ignorenulls=True).over(ahead) for name, fits in fields.items()}
    found = nodes.where("error IS NULL").withColumns({f"_{n}": c for n, c in following.items()}).where(card)
    return found.select(*nodes.columns, *[F.when(F.col(f"_{n}") <= F.col("last"), F.col(f"_{n}")).alias(n) for n in fields])


def inner_texts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, node, text) for ``wanted`` (doc_id, node): all texts inside, white space collapsed.

    A node is in as many wanted intervals as it has wanted ancestors, MOST_DEPTH at most in bounded pages, and its text is
    in as many texts. A node's own texts come before those of its children, as they are kept by element."""
    spans = wanted.distinct().join(nodes.select("doc_id", "node", "last"), ["doc_id", "node"])
    inside = spans.select("doc_id", F.col("node").alias("_top"), F.explode(F.sequence("node", "last")).alias("node"))
    said = inside.join(nodes.where(F.size("parts") > 0).select("doc_id", "node", F.array_join("parts", " ").alias("said")), ["doc_id", "node"], "left")
    whole = said.groupBy("doc_id", "_top").agg(F.array_sort(F.collect_list(F.struct("node", "said"))).alias("said"))
    joined = F.array_join(F.transform("said", lambda s: s["said"]), " ")
    return whole.select("doc_id", F.col("_top").alias("node"), F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")).alias("text"))
