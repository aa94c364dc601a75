"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements, told apart by their role: the chain of tags from the root, with class, id
and role attributes as opaque marks (what they say is never read). A token is known by a hash of that chain, so no
nesting is too deep. Its occurrence vector is how often it stands on each page of a host. Vectors are never gathered:
a token's sum over pages of a hash of (page, count) is the same for two tokens just if their vectors are, so the
classes of equal vectors come from partial aggregates, however many pages a host has.

A token is part of a host's template if it stands on at least half of its pages. There are at most twice as many of
these as a page has tokens on average, which bounds what is gathered of a host. A class holds the template's tokens of
one vector; a token belongs to it only if it nests in the tokens that it stands in everywhere (which its chain says) and
follows the same sibling of its count on every page (``before``), in whole rounds if it repeats. Classes nest into
the template: those that stand once on a page are its skeleton, those that repeat are lists inside of it.

What the template leaves open are slots: texts that differ from page to page. From the root the skeleton is
followed down as long as one element holds at least half of the open prose (text outside links); the last one
holds the article. Headings that differ from page to page beside this way belong to it. Inside the article
these go: elements that HTML itself sets apart (``navigation``, sidebars, forms, scripts, hidden ones ...), containers
that say the same on every page, lists of links that stand once on at least nine of ten of the article's pages (if these are ``SEVERAL`` or more), and lists
of records (a class that repeats with at least two texts to a record, like the readers' comments, but no heading of a
section) that hold less than half of the prose. So an article's own sections and a list of its sources stay, unless the host's
pages all have it. A form is set apart, unless it stands around the page's structure (its article, header, menu or title).

A host is judged by its own pages and by one average page of all hosts: the mean of tokens that stand on at least
half of all hosts (as bounded as above). That decides for hosts of one or two pages and hardly weighs beyond.
A page without its host's article element is judged as if it were a host.

Defined results: a null html counts as empty and gives an empty text; pages whose url names no host are one
host; null and repeated page_ids are returned as they are; an empty table gives an empty result; extra columns
are ignored. Of elements with equally much prose the one that stands first by its hash is followed. The time is
linear in the length of a page, however broken or deep; an attribute whose quote is never closed ends at the next space or '>'.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.llm.common import importable, rows_of, write_shared

#: Bytes up to which all templates are broadcast; parts that a host's pages are split into beyond that.
BROADCAST_BYTES, SALT = 16 << 20, 32
#: Distinct elements that a worker remembers the token of.
REMEMBERED = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html head title option optgroup noscript button caption tbody td tfoot th thead tr legend".split())
#: A start tag ends these open elements, up to the nearest of the second list.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "body": (("head",), ("html",)),
    "p": (("p",), ("button", "table", "td", "article", "body")),
}
#: Elements and ARIA roles that HTML sets apart from the text.
APART = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe svg canvas object embed dialog menu search audio video map".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings of an article's own sections: what repeats under one is no record. Elements that a form around a whole page holds.
SECTION_HEADINGS, STRUCTURE = frozenset("h1 h2 h3".split()), frozenset("article main header footer nav h1".split())
#: What can hold an article, what can be a part of a template within one, what can be a record.
HOLDERS = frozenset("html body main article section div center form table tbody tr td".split())
PARTS, LISTS, RECORDS = frozenset("div section".split()), frozenset("div section ul ol table".split()), frozenset("div section article li".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)>")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]*+)(\s*+=\s*+)?")
_BARE = re.compile(r"[^\s>]*+")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}

#: Pages with the host's article from which on what stands once on nine of ten of them is the host's.
SEVERAL = 3

ROOT = 0
_known: dict[tuple, tuple[int, bool]] = {}


def token(parent: int, tag: str, found: dict[str, str]) -> tuple[int, bool]:
    """The hash of an element's chain, and whether HTML sets the element apart."""
    marks = re.sub(r"\d+", "", f"{' '.join(sorted(found.get('class', '').split()))}#{found.get('id', '')}#{found.get('role', '').lower()}") if found else ""
    key = (parent, tag, marks, "hidden" in found or "aria-hidden" in found or "style" in found)
    if key[3] or key not in _known:
        style = found.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in found or "display:none" in style or found.get("aria-hidden", "").lower() == "true"
        made = (xxhash.xxh64_intdigest(f"{parent}/{tag}/{marks}/{hidden}") >> 1 or 1, hidden or tag in APART or found.get("role", "").lower() in APART_ROLES)
        if key[3]:
            return made
        if len(_known) > REMEMBERED:
            _known.clear()
        _known[key] = made
    return _known[key]


def tags(page: str) -> Iterator[tuple[str, str, object]]:
    """Events in page order: ('text', '', raw), ('start', tag, attributes), ('end', tag, None). Linear in the length."""
    at, n = 0, len(page)
    ends = {"-->": True, ">": True, '"': True, "'": True}  # False once none is left

    def find(what: str, start: int) -> int:
        if not ends[what]:
            return -1
        place = page.find(what, start)
        if place < 0:
            ends[what] = False
        return place

    closed = dict.fromkeys(RAW, True)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        found: dict[str, str] = {}
        m = _PLAIN.match(page, start)
        if m:
            closing, tag, at = m[1], m[2].lower(), m.end()
            tag = tag if m[2].isascii() else m[2]
        else:
            after = page[start + 1 : start + 2]
            if after in ("!", "?"):
                comment = page.startswith("<!--", start)
                stop = find("-->", start + 2) if comment else find(">", start)
                at = n if stop < 0 else stop + (3 if comment else 1)
                continue
            closing = "/" if after == "/" else ""
            name = _NAME.match(page, start + 1 + len(closing))
            if not name:
                if closing:
                    stop = find(">", start)
                    at = n if stop < 0 else stop + 1
                else:
                    yield "text", "", "<"
                    at = start + 1
                continue
            tag, at = name[0].lower(), name.end()
            while True:
                m = _ATTRIBUTE.match(page, at)
                at = m.end()
                value = ""
                if m[2]:
                    quote = page[at : at + 1]
                    stop = find(quote, at + 1) if quote in ('"', "'") and quote else -1
                    if stop >= 0:
                        value, at = page[at + 1 : stop], stop + 1
                    else:
                        bare = _BARE.match(page, at)
                        value, at = bare[0], bare.end()
                if m[1] and not closing:
                    found.setdefault(m[1].lower(), html.unescape(value))
                if at >= n or page[at] == ">":
                    at += 1
                    break
                if not m[0] and not value:  # a stray sign
                    at += 1
        if closing:
            yield "end", tag, None
            continue
        yield "start", tag, found
        if tag in RAW:
            end = _END[tag].search(page, at) if closed[tag] else None
            if end is None:
                closed[tag] = False
            if tag in ("textarea", "title"):
                yield "text", "", page[at : end.start() if end else n]
            at = n
            if end:
                stop = find(">", end.end())
                at = n if stop < 0 else stop + 1
            yield "end", tag, None


def outer_forms(page: str) -> set[int]:
    """Which forms of a page, counted from 0, hold its structure: they stand around the page and are not set apart from it."""
    if not re.search("<form", page, re.I):
        return set()
    found, number, inside = set(), -1, False
    for kind, tag, _ in tags(page):
        if tag == "form":
            number, inside = number + (kind == "start"), kind == "start"
        elif inside and kind == "start" and tag in STRUCTURE:
            found.add(number)
    return found


class Seen:
    """What a page says of one token."""

    __slots__ = ("parent", "tag", "apart", "count", "own", "prose", "links", "said", "before")

    def __init__(self, parent: int, tag: str, apart: bool):
        self.parent, self.tag, self.apart = parent, tag, apart
        self.count = self.own = self.prose = self.links = self.said = 0
        self.before = 0


def read(page: str | None, kept: frozenset | None = None, dropped: frozenset = frozenset()) -> tuple[list[str], dict[int, Seen]]:
    """The texts inside the elements ``kept`` (None: count tokens instead), and what the page says of its tokens."""
    count, mask = kept is None, (1 << 63) - 1
    texts: list[str] = []
    seen: dict[int, Seen] = {ROOT: Seen(-1, "", False)}
    seen[ROOT].count = 1
    children: dict[int, list[int]] = defaultdict(list)
    # An open element: tag, token, is a block, set apart, in a kept one, header; prose, links and hash of what it holds.
    stack: list[list] = [["", ROOT, True, 0, int(kept is not None and ROOT in kept), 0, 0, 0, 0]]
    open_at: dict[str, list[int]] = defaultdict(list)
    blocks = [0]  # places of open blocks
    words: list[str] = []
    state = [0, 0]  # characters of links in this text; open links

    def flush() -> None:
        if words:
            whole = " ".join("".join(words).split())
            if whole:
                if count:
                    top = stack[blocks[-1]]
                    inside = min(state[0], len(whole))
                    top[6] += len(whole) - inside
                    top[7] += inside
                    top[8] = (top[8] * 1_000_003 + xxhash.xxh64_intdigest(whole)) & mask
                    seen[top[1]].own += len(whole) - inside
                else:
                    texts.append(whole)
            words.clear()
        state[0] = 0

    def pop(upto: int) -> None:
        while len(stack) > upto:
            last = stack[-1]
            if last[2]:
                flush()
                blocks.pop()
            stack.pop()
            open_at[last[0]].pop()
            state[1] -= last[0] == "a"
            if count:
                one, above = seen[last[1]], stack[-1]
                one.prose += last[6]
                one.links += last[7]
                one.said = (one.said * 1_000_003 + last[8]) & mask
                if not one.apart:
                    above[6] += last[6]
                    above[7] += last[7]
                    above[8] = (above[8] * 1_000_003 + last[8] + 1) & mask

    around, forms = outer_forms(page or ""), -1
    for kind, tag, what in tags(page or ""):
        top = stack[-1]
        if kind == "text":
            # A header's text is not the article's, its headings are.
            if not top[3] and (count or top[4] and not top[5]):
                found = html.unescape(what)
                words.append(found)
                if state[1]:
                    state[0] += len(" ".join(found.split()))
            continue
        if kind == "end":
            places = open_at.get(tag)
            if places:
                pop(places[-1])
            elif tag == "p":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        for rule in (("p",) if tag in CLOSES_P else ()) + ((tag,) if tag in IMPLIED and tag != "p" else ()):
            ends, within = IMPLIED[rule]
            barrier = max((open_at[t][-1] for t in within if open_at.get(t)), default=-1)
            low = len(stack)
            for t in ends:
                places = open_at.get(t)
                if places and places[-1] > barrier:
                    low = min(low, places[-1] if rule == "p" else places[bisect_right(places, barrier)])
            pop(low)
        if tag in BLOCKS:
            flush()
        top = stack[-1]
        me, apart = token(top[1], tag, what)
        if tag == "form":
            forms += 1
            apart = apart and (forms not in around or "hidden" in what)
        if count:
            one = seen.get(me)
            if one is None:
                one = seen[me] = Seen(top[1], tag, apart)
            one.count += 1
            children[top[1]].append(me)
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            continue
        header = 0 if tag in HEADINGS else 1 if tag == "header" else top[5]
        inside = int(top[4] or not count and me in kept)
        away = int(top[3] or apart or not count and me in dropped)
        stack.append([tag, me, tag in BLOCKS, away, inside, header, 0, 0, 0])
        open_at[tag].append(len(stack) - 1)
        if tag in BLOCKS:
            blocks.append(len(stack) - 1)
        state[1] += tag == "a"
    pop(1)
    flush()
    if count:
        root = seen[ROOT]
        root.prose, root.links, root.said = stack[0][6:9]
        for row in children.values():
            rounds: dict[int, list[int]] = defaultdict(list)
            for c in row:
                rounds[seen[c].count].append(c)
            for times, some in rounds.items():
                first = some[: len(some) // times]
                whole = len(some) % times == 0 and some == first * times
                for i, c in enumerate(first if whole else set(some)):
                    seen[c].before = (first[i - 1] if i else 0) if whole else -1
    return texts, seen


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


#: Of a token on a host: aggregates over pages.
SUMS, RANGES = ("vector", "pages", "total", "own", "prose", "links"), ("said", "before")
FIELDS = ("token", "parent", "tag", "apart", *SUMS, *[f"{a}_{b}" for b in RANGES for a in ("low", "high")])
TOKENS = "host string, token long, parent long, tag string, apart boolean, " + ", ".join(f"{c} long" for c in FIELDS[4:])


def _rows(seen: dict[int, Seen], key: int) -> Iterator[tuple]:
    for me, s in seen.items():
        vector = xxhash.xxh64_intdigest(s.count.to_bytes(8, "little"), key) & (1 << 40) - 1
        yield me, s.parent, s.tag, s.apart, vector, 1, s.count, s.own, s.prose, s.links, s.said, s.said, s.before, s.before


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens by host, summed over the pages of a batch."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 10)
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for page, url, raw in rows_of(batch, "page_id", "url", "html"):
            key, host = xxhash.xxh64_intdigest(f"{page}\x00{url}\x00{raw}"), host_of(url)
            for row in _rows(read(raw)[1], key):
                total = found.get((host, row[0]))
                if total is None:
                    found[host, row[0]] = [host, *row]
                    continue
                for i in range(5, 11):
                    total[i] += row[i - 1]
                total[5] &= (1 << 40) - 1  # sums of hashes modulo 2^40 stay sums
                for i in (11, 13):
                    total[i], total[i + 1] = min(total[i], row[i - 1]), max(total[i + 1], row[i - 1])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found.values()), kinds)], names=["host", *FIELDS])


def deduce(tokens: list[dict], pages: int) -> tuple[list[int], list[int]]:
    """(kept, dropped) tokens of the template of a host, given its tokens that stand on at least half of ``pages``.

    A token also has ``mean``, its prose on the average page of all hosts, and that page's ``mean_links``.
    """
    by = {t["token"]: t for t in tokens}
    inner: dict[int, list[int]] = defaultdict(list)
    for t in tokens:
        if t["token"] != ROOT and t["parent"] in by:
            inner[t["parent"]].append(t["token"])
    # Tokens in the order of a walk; what stands under one comes right after it, up to its last.
    order, todo, place, last = [], [ROOT], {}, {}
    while todo:
        k = todo.pop()
        place[k] = last[k] = len(order)
        order.append(k)
        todo += sorted(inner[k], reverse=True)
    for k in reversed(order):
        if k != ROOT:
            last[by[k]["parent"]] = max(last[by[k]["parent"]], last[k])
    some_differ = any(t["low_said"] != t["high_said"] for t in tokens)
    same = {k: some_differ and by[k]["pages"] > 1 and by[k]["low_said"] == by[k]["high_said"] for k in order}
    prose, open_ = {}, {}
    for k in reversed(order):
        t = by[k]
        prose[k] = t["prose"] + t["mean"]
        rest = prose[k] - sum(prose[c] for c in inner[k] if not by[c]["apart"])
        open_[k] = 0 if same[k] or t["apart"] else max(0, rest) + sum(open_[c] for c in inner[k])
    # Down the skeleton.
    way = [ROOT]
    while True:
        fits = [c for c in sorted(inner[way[-1]]) if by[c]["tag"] in HOLDERS and by[c]["total"] == by[c]["pages"]]
        best = max(fits, key=open_.get, default=None)
        if best is None or not open_[best] or 2 * open_[best] < open_[way[-1]]:
            break
        way.append(best)
    article, kept = way[-1], [way[-1]]
    for above, below in zip(way, way[1:]):
        for c in inner[above]:
            inside = inner[c] if by[c]["tag"] == "header" and by[above]["tag"] not in ("body", "html", "") else [c]
            kept += [h for h in inside if c != below and by[h]["tag"] in HEADINGS and by[h]["total"] == by[h]["pages"] and not same[h]]
    # Inside the article.
    classes: dict[tuple, list[int]] = defaultdict(list)  # where its members that say something stand
    headed: dict[tuple, list[int]] = defaultdict(list)  # where its headings stand
    alike = lambda t: (t["vector"], t["pages"], t["total"])
    for k in order:
        t = by[k]
        if t["own"] > 0 and t["tag"] in BLOCKS and t["low_before"] == t["high_before"] and t["low_before"] >= 0:
            classes[alike(t)].append(place[k])
            if t["tag"] in SECTION_HEADINGS:
                headed[alike(t)].append(place[k])
    dropped, todo = [], list(inner[article])
    while todo:
        k = todo.pop()
        t = by[k]
        record = t["tag"] in RECORDS and t["total"] > t["pages"] and 2 * prose[k] < prose[article]
        if record:
            below = lambda places: bisect_right(places, last[k]) - bisect_right(places, place[k])  # noqa: B023, E731
            record = below(classes[alike(t)]) > 1 and not below(headed[alike(t)])
        everywhere = by[article]["pages"] >= SEVERAL and 10 * t["pages"] >= 9 * by[article]["pages"] and t["total"] == t["pages"]
        listed = everywhere and t["tag"] in LISTS and 5 * t["links"] >= 4 * (t["links"] + t["prose"]) > 0
        if t["tag"] in PARTS and same[k] or listed or record:
            dropped.append(k)
        else:
            todo += inner[k]
    return sorted(set(kept)), sorted(dropped)


def _templates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [json.dumps(deduce(tokens, pages)) for tokens, pages in rows_of(batch, "tokens", "host_pages")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """host, template: JSON of the tokens that a host's template keeps and drops."""
    rows = pages.mapInArrow(_tokens, TOKENS)
    ranges = [F.min(f"low_{c}").alias(f"low_{c}") for c in RANGES] + [F.max(f"high_{c}").alias(f"high_{c}") for c in RANGES]
    sums = [F.sum(F.pmod("vector", F.lit(1 << 40))).alias("vector"), *[F.sum(c).alias(c) for c in SUMS[1:]]]
    summed = write_shared(rows.groupBy("host", "token").agg(*[F.min(c).alias(c) for c in ("parent", "tag", "apart")], *sums, *ranges), "tokens")
    roots = summed.where(F.col("token") == ROOT)
    hosts = roots.select("host", F.col("pages").alias("host_pages"))
    supported = summed.join(hosts, "host").where(2 * F.col("pages") >= F.col("host_pages"))
    # The average page: tokens of at least half of all hosts, a host counting once.
    number = hosts.count()
    each = supported.select("token", (F.col("prose") / F.col("host_pages")).alias("p"))
    mean = each.groupBy("token").agg(F.count("*").alias("hosts"), (F.sum("p") / max(1, number)).cast("long").alias("mean")).where(2 * F.col("hosts") >= number)
    told = supported.withColumn("vector", F.pmod("vector", F.lit(1 << 40))).join(F.broadcast(mean.select("token", "mean")), "token", "left").withColumn("mean", F.coalesce("mean", F.lit(0)))
    gathered = told.groupBy("host").agg(F.collect_list(F.struct(*FIELDS, "mean")).alias("tokens"), F.max("host_pages").alias("host_pages"))
    return gathered.mapInArrow(_templates, "host string, template string")


def alone(page: str | None) -> tuple[frozenset, frozenset]:
    """The template of a page that is a host of its own."""
    tokens = [dict(zip(FIELDS, row)) | {"mean": 0} for row in _rows(read(page)[1], 0)]
    kept, dropped = deduce(tokens, 1)
    return frozenset(kept), frozenset(dropped)


def extract(page: str | None, kept: frozenset, dropped: frozenset) -> str:
    """The text of the page's slots inside the article."""
    texts = read(page, kept, dropped)[0] if kept and ROOT not in kept else []
    return "\n\n".join(texts or read(page, *alone(page))[0])


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, tuple[frozenset, frozenset]] = {}
    for batch in batches:
        texts = []
        for raw, template in rows_of(batch, "html", "template"):
            if template not in known:
                if len(known) > 2000:
                    known.clear()
                kept, dropped = json.loads(template or "[[], []]")
                known[template] = frozenset(kept), frozenset(dropped)
            texts.append(extract(raw, *known[template]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars."""
    importable(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    made = write_shared(templates(rows), "templates")
    size = made.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    placed = rows.withColumn("host", host)
    if size <= broadcast_bytes:
        joined = placed.join(F.broadcast(made), "host", "left")
    else:  # the pages of a hot host are spread, its template is repeated
        salted = made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = placed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
