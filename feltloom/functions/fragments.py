"""Text of HTML fragments, Arrow-batched: what needs the tree but not its nodes."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that stand on lines of their own, and those whose text isn't read.
LINE_ELEMENTS = frozenset("address article blockquote div h1 h2 h3 h4 h5 h6 li ol p section table td th tr ul".split())
UNREAD = frozenset("script style template head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    def __init__(self, blocks: bool):
        super().__init__(convert_charrefs=True)
        self.blocks, self.out, self.hrefs, self.skip = blocks, [], [], 0

    def _last(self) -> str:
        return self.out[-1][-1:] if self.out else ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.out.append("\n")
        if not self.blocks:
            return
        if tag in UNREAD:
            self.skip += 1
        if tag in LINE_ELEMENTS:
            self.out.append("\n")
        if tag == "a":
            href = (dict(attrs).get("href") or "").strip()
            self.hrefs.append(href if href.startswith(("https://", "http://")) else "")
            if self._last() not in ("", " ", "\n", "("):
                self.out.append(" ")

    def handle_endtag(self, tag):
        if not self.blocks:
            return
        if tag in UNREAD and self.skip:
            self.skip -= 1
        if tag == "a" and self.hrefs and (href := self.hrefs.pop()):
            self.out.append(f" ({href})")
        if tag in LINE_ELEMENTS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def text_of(fragment: str | None, blocks: bool) -> str:
    parser = _Text(blocks)
    parser.feed(fragment or "")
    parser.close()
    return "".join(parser.out)


def tree_text(nodes: list[tuple]) -> str:
    """The same of a parsed subtree, with lines for block elements and links as ``text (address)``."""
    text, ends = _Text(True), []
    for n in nodes:
        while ends and ends[-1][0] < n[0]:
            text.handle_endtag(ends.pop()[1])
        if n[4] == "text":
            text.handle_data(n[7])
        else:
            text.handle_starttag(n[5], [("href", n[6].get("href"))])
            if n[5] not in VOID:
                ends.append((n[2], n[5]))
    for _, tag in reversed(ends):
        text.handle_endtag(tag)
    return "".join(text.out)


def _plain(fragments: pd.Series) -> pd.Series:
    return fragments.map(lambda x: text_of(x, False))


def _lines(fragments: pd.Series) -> pd.Series:
    return fragments.map(lambda x: text_of(x, True))


def break_text(fragment: Column) -> Column:
    """The text with a line feed for each <br>."""
    return F.pandas_udf(_plain, StringType())(fragment)


def block_text(fragment: Column) -> Column:
    """The text with lines for block elements and links as ``text (address)``."""
    return F.pandas_udf(_lines, StringType())(fragment)
