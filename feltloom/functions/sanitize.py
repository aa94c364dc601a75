"""HTML fragments made safe to show: an allowlist of elements, attributes, styles and URLs."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is kept, what goes with all that is in it, and what a style may not say.
ALLOWED_TAGS = {"br", "code", "em", "h3", "h4", "img", "li", "ol", "p", "pre", "span", "strong", "ul"}
DROPPED_TAGS = {"base", "embed", "form", "head", "iframe", "link", "math", "meta", "noscript", "object", "script", "style", "svg", "template", "title"}
IMAGE_ATTRIBUTES = {"alt", "width", "height", "title"}
STYLE_BANNED = ("url(", "expression", "javascript:", "@import", "\\", "<", ">")
STYLE_MARKS = " #-;:,.%()"

_VOID = {"br", "img", "base", "embed", "link", "meta", "area", "col", "hr", "input", "source", "track", "wbr"}
_P_ENDS = {"p", "ul", "ol", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "div", "table", "form", "blockquote", "section", "article"}


def _escape(x: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        x = x.replace(plain, entity)
    return x


def web_url(raw: str) -> bool:
    try:
        parts = urlsplit(raw.strip())
    except ValueError:
        return False
    return parts.scheme in ("http", "https") and bool(parts.netloc)


def style_allowed(value: str) -> bool:
    low = value.lower()
    return not any(b in low for b in STYLE_BANNED) and all(c.isascii() and c.isalnum() or c in STYLE_MARKS for c in value)


class _Cleaner(HTMLParser):
    """Writes as it reads; ``open`` has (tag, whether it was written)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []
        self.dropping = 0

    def handle_starttag(self, tag, attrs):
        if tag in _P_ENDS:
            self._implied("p", {"li", "ul", "ol", "div"})
        if tag == "li":
            self._implied("li", {"ul", "ol"})
        if tag in DROPPED_TAGS:
            if tag not in _VOID:
                self.open.append((tag, False))
                self.dropping += 1
            return
        written = tag in ALLOWED_TAGS and not self.dropping
        if written:
            kept = [(n, v or "") for n, v in attrs if self._allowed(tag, n, v or "")]
            if tag == "img" and not any(n == "src" for n, _ in kept):
                return
            self.out.append(f"<{tag}" + "".join(f' {n}="{_escape(v)}"' for n, v in kept) + ">")
        if tag not in _VOID:
            self.open.append((tag, written))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    @staticmethod
    def _allowed(tag, name, value):
        if name == "src":
            return tag == "img" and web_url(value)
        if name in IMAGE_ATTRIBUTES:
            return tag == "img"
        return name == "style" and tag != "img" and style_allowed(value)

    def _implied(self, tag, within):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if self.open[i][0] in within:
                return

    def _pop(self, to):
        while len(self.open) > to:
            tag, written = self.open.pop()
            if tag in DROPPED_TAGS:
                self.dropping -= 1
            elif written:
                self.out.append(f"</{tag}>")

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return

    def handle_data(self, data):
        if not self.dropping:
            self.out.append(_escape(data))


def clean(fragment: str | None) -> str | None:
    if fragment is None:
        return None
    cleaner = _Cleaner()
    cleaner.feed(fragment)
    cleaner.close()
    cleaner._pop(0)
    return "".join(cleaner.out)


def _clean_all(fragments: pd.Series) -> pd.Series:
    return fragments.map(clean)


def safe_html(fragment: Column | str) -> Column:
    """A tree rewrite, which built-in functions cannot express: one Arrow-batched function."""
    return F.pandas_udf(_clean_all, StringType())(F.col(fragment) if isinstance(fragment, str) else fragment)
