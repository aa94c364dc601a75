"""Pages as tables of nodes, and selections on them.

``dom_nodes`` parses whole batches of pages in one Arrow pass; ``parse_html`` is the same as a table
function for SQL. Nodes carry their place, parent and the end of their subtree, so that selections are
plain filters and joins. End tags that HTML lets one leave out are implied for p, li, dt, dd, option and
table parts; nothing is moved out of tables. Elements more than ``MAX_DEPTH`` deep stand beside each other at that
depth, as in browsers, so a page's tree takes time in proportion to its length.

Texts below elements are found by a sweep: one running sum over a page's nodes in document order gives each element its
span of the page's text, and the spans are cut out of it where the page is one row.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import unescape
from itertools import chain, repeat
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from feltloom.functions.fragments import VOID
from feltloom.functions.text import collapse_space
from feltloom.model import DOM_NODES
from feltloom.sources.scan import Scanner, usual

# Elements without content, those that end an open paragraph, implied ends.
MAX_DEPTH = 512
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"})}
#: Tags that neither end others nor are without content.
_INLINE = frozenset("a abbr article b button code em footer header h1 h2 h3 h4 h5 h6 i iframe main nav s section small span strong sub sup u".split()) - ENDS_P


@lru_cache(64)
def _loose(text_of: frozenset) -> tuple[frozenset, dict, frozenset]:
    """Tags without a text of their own that never end others; that don't right below one of some tags; that don't unless a p is open."""
    return _INLINE - text_of, {t: within for t, (_, within) in SAME.items() if t not in text_of}, ENDS_P - VOID - text_of


class _Tree:
    """Nodes of a page in one pass. Where an element of a tag is open is known by tag, so no end looks through all that is open."""

    def __init__(self, page: str, text_of: frozenset):
        self.nodes: list[list] = []  # pos, parent, subtree_end, depth, kind, tag, attrs, text
        self.open: list[int] = []  # their positions
        self.places: dict[str, list[int]] = defaultdict(list)  # by tag: places in ``open``
        self.said: list[str] = []  # texts; nodes note where theirs ends, ``from_`` where it begins
        self.length, self.text_of, self.from_ = 0, text_of, {}
        tokens = usual(page)
        if tokens is None:
            self._events(Scanner(page).events())
        else:
            self._tokens(*tokens)
        self._close(0)
        whole = "".join(self.said)
        for pos, start in self.from_.items():
            self.nodes[pos][7] = whole[start : self.nodes[pos][7]]

    def _tokens(self, before: str, tags: list[tuple], texts: list[str]) -> None:
        """The same as ``_events`` in one plain loop: texts never meet here, and most tags neither end others nor are without content."""
        nodes, opened, said, places = self.nodes, self.open, self.said, self.places
        plain, same, blocks = _loose(self.text_of)
        for (closing, tag, attrs), text in chain((((None, "", {}), before),), zip(tags, texts)):
            if closing:
                if at := places.get(tag):
                    if at[-1] == len(opened) - 1 and tag not in self.text_of:
                        nodes[opened.pop()][2] = len(nodes) - 1
                        at.pop()
                    else:
                        self._close(at[-1])
            elif tag in plain or tag in same and opened and nodes[opened[-1]][5] in same[tag] or tag in blocks and not places.get("p"):
                pos, depth = len(nodes), len(opened)
                nodes.append([pos, opened[-1] if depth else -1, pos, depth, "element", tag, attrs, None])
                if depth < MAX_DEPTH:
                    places[tag].append(depth)
                    opened.append(pos)
            elif tag:
                self._start(tag, attrs)
            if text:
                if "&" in text:
                    text = unescape(text)
                said.append(text)
                self.length += len(text)
                pos, depth = len(nodes), len(opened)
                nodes.append([pos, opened[-1] if depth else -1, pos, depth, "text", None, None, text])

    def _events(self, events: Iterable[tuple]) -> None:
        joins = False
        for kind, name, attrs in events:
            if kind == "text":
                if not joins:
                    self.from_[self._add("text", None, None)] = self.length
                self.said.append(name)
                self.length += len(name)
                self.nodes[-1][7] = self.length
                joins = True
                continue
            joins = False
            if kind == "start":
                self._start(name, attrs)
            elif kind == "end" and self.places.get(name):
                self._close(self.places[name][-1])

    def _add(self, kind: str, tag: str | None, attrs: dict | None) -> int:
        pos = len(self.nodes)
        self.nodes.append([pos, self.open[-1] if self.open else -1, pos, len(self.open), kind, tag, attrs, None])
        return pos

    def _start(self, tag: str, attrs: dict) -> None:
        if tag in ENDS_P and self.places.get("p"):
            self._end_open(("p",), ("table", "td", "button"))
        if tag in SAME:
            self._end_open(*SAME[tag])
        pos = len(self.nodes)
        self.nodes.append([pos, self.open[-1] if self.open else -1, pos, len(self.open), "element", tag, attrs, None])
        if tag in self.text_of:
            self.from_[pos] = self.length
            self.nodes[pos][7] = self.length
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.places[tag].append(len(self.open))
            self.open.append(pos)

    def _last(self, tags: Iterable[str]) -> int:
        last = -1
        for t in tags:
            places = self.places.get(t)
            if places and places[-1] > last:
                last = places[-1]
        return last

    def _end_open(self, ends: Iterable[str], within: Iterable[str]) -> None:
        at = self._last(ends)
        if at >= 0 and at > self._last(within):
            self._close(at)

    def _close(self, to: int) -> None:
        last = len(self.nodes) - 1
        while len(self.open) > to:
            node = self.nodes[self.open.pop()]
            self.places[node[5]].pop()
            node[2] = last
            if node[0] in self.from_:
                node[7] = self.length


def tree(page: str | None, text_of: frozenset = frozenset()) -> list[list]:
    """Nodes of a page; elements of the tags ``text_of`` carry the text below them."""
    return _Tree(page or "", text_of).nodes


def parse(page: str | None, text_of: frozenset = frozenset()) -> list[tuple]:
    """The same as rows."""
    return [tuple(n) for n in tree(page, text_of)]


# What helpers of one page's nodes share: they run where the page is one row, which spares shuffles of nodes.

_CLASSES = re.compile(r"[\s\x0b]+", re.A)


def of_class(node: tuple, name: str) -> bool:
    value = (node[6] or {}).get("class")
    return bool(value) and name in value and name in _CLASSES.split(value)


def first_within(nodes: list[tuple], places: list[int], root: tuple) -> tuple | None:
    """The first of the nodes at ``places`` (ascending) that is the root or below it."""
    at = bisect_left(places, root[0])
    return nodes[places[at]] if at < len(places) and places[at] <= root[2] else None


def anchor_texts(page: str | None, without: str) -> list[tuple]:
    """pos, href and text of every anchor, but for the text of elements of a class."""
    nodes, said, before, out = tree(page), [], [], -1
    for n in nodes:
        before.append(len(said))
        if n[4] == "text":
            if n[0] > out:
                said.append(n[7])
        elif of_class(n, without):
            out = max(out, n[2])
    before.append(len(said))
    return [(n[0], n[6].get("href", ""), "".join(said[before[n[0]] : before[n[2] + 1]])) for n in nodes if n[5] == "a"]


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did."""
    top, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (top, *paths) if p)


#: Text handled at a time, and the fewest pages.
BATCH_BYTES, BATCH_PAGES = 4 << 20, 64


def page_rows(pages: DataFrame, body: str, read: Callable[[str | None], list[tuple]], schema: str, *keys: str) -> DataFrame:
    """The keys and what ``read`` tells of each page, any number of rows, in one Arrow pass. Maps are given as dicts."""
    importable(pages.sparkSession)
    fields_of = StructType.fromDDL(schema)
    names, kinds = fields_of.names, [f.type for f in to_arrow_schema(fields_of)]

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        return pa.array([None if x is None else list(x.items()) for x in values] if pa.types.is_map(kind) else values, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(len(keys))
            step = max(BATCH_PAGES, batch.num_rows * BATCH_BYTES // max(1, bodies.nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                found = [read(x) for x in part.column(len(keys)).to_pylist()]
                rows = list(chain.from_iterable(found))
                if not rows:
                    continue
                at = pa.array(chain.from_iterable(map(repeat, range(len(found)), map(len, found))), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(keys))), *map(column, zip(*rows), kinds)], names=[*keys, *names])

    kept = pages.select(*keys, F.col(body).alias("__body"))
    return kept.mapInArrow(run, ", ".join([*(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys), schema]))


def dom_nodes(pages: DataFrame, body: str, *keys: str, text_of: tuple[str, ...] = ()) -> DataFrame:
    """The keys and all nodes of each page. ``text_of``: tags whose elements carry the text below them, which
    spares most selections a join."""
    wanted = frozenset(text_of)
    return page_rows(pages, body, lambda page: parse(page, wanted), DOM_NODES, *keys)


def register(spark: SparkSession) -> None:
    """``SELECT ... FROM pages, LATERAL parse_html(html)``."""
    importable(spark)

    class ParseHtml:
        def eval(self, page: str):
            yield from parse(page)

    spark.udtf.register("parse_html", F.udtf(ParseHtml, returnType=DOM_NODES))


def has_class(name: str, attrs: Column | str = "attrs") -> Column:
    """Whether a name is one of an element's classes."""
    value = F.element_at(F.col(attrs) if isinstance(attrs, str) else attrs, "class")
    return F.coalesce(F.array_contains(F.split(F.trim(value), r"[\s\x{0B}]+"), name), F.lit(False))


def attribute(name: str, attrs: Column | str = "attrs") -> Column:
    """An attribute, empty if it is missing."""
    return F.coalesce(F.element_at(F.col(attrs) if isinstance(attrs, str) else attrs, name), F.lit(""))


def int_attribute(name: str, attrs: Column | str = "attrs") -> Column:
    return F.coalesce(attribute(name, attrs).try_cast("int"), F.lit(0))


def elements(nodes: DataFrame, tag: str | None = None, cls: str | None = None) -> DataFrame:
    """Elements by tag and class; ``pos`` is their document order."""
    found = nodes.where("kind = 'element'")
    if tag:
        found = found.where(F.col("tag") == tag)
    return found.where(has_class(cls)) if cls else found


def first_element(found: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.min_by(F.struct(*rest), "pos").alias("e")).select(*keys, "e.*")


def children(nodes: DataFrame, parents: DataFrame, key: str, tag: str) -> DataFrame:
    """Direct children of the given elements with a tag, and ``of``, the parent's place."""
    return nodes.where((F.col("kind") == "element") & (F.col("tag") == tag)).join(parents.select(key, F.col("pos").alias("of")), (nodes[key] == parents[key]) & (F.col("parent") == F.col("of"))).drop(parents[key])


def covered(nodes: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Nodes with ``covered``: whether they stand within one of ``spans`` (keys, pos, subtree_end), by a running maximum of ends."""
    ends = spans.select(*keys, "pos", F.col("subtree_end").alias("ends"))
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = nodes.join(ends, [*keys, "pos"], "left").withColumn("ends", F.max("ends").over(upto))
    return marked.withColumn("covered", F.coalesce(F.col("ends") >= F.col("pos"), F.lit(False))).drop("ends")


def subtree_text(nodes: DataFrame, roots: DataFrame, *keys: str, without: DataFrame | None = None) -> DataFrame:
    """keys, of, content: the text below each element as written; ``without``: elements whose text is left out."""
    said = F.when(F.col("kind") == "text", F.col("text"))
    thin = nodes.select(*keys, "pos", "kind", "text")
    if without is not None:
        thin, said = covered(thin, without, *keys), F.when((F.col("kind") == "text") & ~F.col("covered"), F.col("text"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    measured = thin.select(*keys, "pos", said.alias("said")).withColumn("start", F.coalesce(F.sum(F.octet_length("said")).over(before), F.lit(0)))
    starts = roots.select(*keys, "pos", "subtree_end").join(measured.select(*keys, "pos", "start"), [*keys, "pos"])
    ends = measured.select(*keys, F.col("pos").alias("subtree_end"), (F.col("start") + F.coalesce(F.octet_length("said"), F.lit(0))).alias("stop"))
    spans = starts.join(ends, [*keys, "subtree_end"]).groupBy(*keys).agg(F.collect_list(F.struct("pos", "start", "stop")).alias("spans"))
    whole = measured.where("said is not null").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "").cast("binary").alias("whole"))
    cut = lambda s: F.substring(F.col("whole"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")).cast("string")
    page = spans.join(whole, list(keys), "left")
    each = page.select(*keys, F.explode(F.transform("spans", lambda s: F.struct(s["pos"].alias("of"), F.coalesce(cut(s), F.lit("")).alias("content")))).alias("e"))
    return each.select(*keys, "e.*")


def links(nodes: DataFrame, key: str) -> DataFrame:
    """key, pos, href, content of every anchor with an href."""
    anchors = elements(nodes, "a").where(F.map_contains_key("attrs", F.lit("href")))
    text = subtree_text(nodes, anchors, key).withColumnRenamed("of", "pos")
    return anchors.select(key, "pos", attribute("href").alias("href")).join(text, [key, "pos"]).withColumn("content", collapse_space("content"))
