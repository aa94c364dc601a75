"""A scanner of HTML that reads each character a bounded number of times, whatever the page looks like.

It follows what browsers make of broken markup where pages depend on it: comments that never end run to the end, a quote
that is never closed is part of a bare value, and what can't be a tag is text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

# Elements whose content is no markup, and those of them whose character references count.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
DECODED = frozenset(("textarea", "title"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# What most pages are made of, in one match: a text, or a tag whose attributes all stand in double quotes.
_USUAL = re.compile(r'([^<]++)|<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:\s++[a-zA-Z-]++="[^"]*+")*+)\s*+>')
_HEAD = re.compile(r'(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:\s++[a-zA-Z-]++="[^"]*+")*+)\s*+')
# A page whose signs open and close tags in turn.
_IN_TURN = re.compile(r"[^<>]*+(?:<[^<>]*+>[^<>]*+)*+")
_PAIRS = re.compile(r'([a-zA-Z-]++)="([^"]*+)"')
_FIELD = re.compile(r"[\s/]*+([^\s/>=]*+)(\s*+=\s*+)?")
_BARE = re.compile(r"[^\s>]*+")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


#: Characters of a tag up to which what it says is kept.
_SHORT = 200


def fields(pairs: str) -> dict[str, str]:
    """Attributes in double quotes; the first of those with one name."""
    found: dict[str, str] = {}
    for name, value in _PAIRS.findall(pairs):
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def head(said: str) -> tuple[str, str, dict[str, str]] | None:
    """'/' if it ends, tag and attributes of what stands between the signs of a usual tag; None if it is none or its content is no markup."""
    m = _HEAD.fullmatch(said)
    if not m:
        return None
    closing, tag, pairs = m.groups()
    tag = tag.lower()
    return None if tag in RAW and not closing else (closing, tag, fields(pairs) if pairs and not closing else {})


#: Most tags of most pages say the same. Attributes are shared, so not to be changed.
_known_head = lru_cache(1 << 12)(head)


def usual(page: str) -> tuple[str, list[tuple[str, str, dict]], list[str]] | None:
    """A page that is all texts and usual tags: the text before the first, what ``head`` tells of each, the text behind each. None if it isn't."""
    if not _IN_TURN.fullmatch(page):
        return None
    said = page.replace(">", "<").split("<")
    tags = said[1::2]
    known = list(map(_known_head if max(map(len, tags), default=0) < _SHORT else head, tags))
    return None if None in known else (said[0], known, said[2::2])


class Scanner:
    """Events of one page in order: ('text', text, None), ('start', tag, attributes), ('end', tag, None), ('gap', '', None)."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.none_left: set[str] = set()  # what is known not to come any more, so that it is looked for once

    def _find(self, what: str, start: int) -> int:
        if what in self.none_left:
            return -1
        place = self.page.find(what, start)
        if place < 0:
            self.none_left.add(what)
        return place

    def _past(self, what: str, start: int) -> int:
        """The place after ``what``, or the end."""
        place = self._find(what, start)
        return len(self.page) if place < 0 else place + len(what)

    def _fields(self, wanted: bool) -> dict[str, str]:
        """Attributes from here to the end of the tag; the first of those with one name."""
        page, found = self.page, {}
        while True:
            m = _FIELD.match(page, self.at)
            self.at, value = m.end(), ""
            if m[2]:
                quote = page[self.at : self.at + 1]
                stop = self._find(quote, self.at + 1) if quote and quote in "\"'" else -1
                if stop >= 0:
                    value, self.at = page[self.at + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(page, self.at)
                    value, self.at = bare[0], bare.end()
            if m[1] and wanted:
                found.setdefault(m[1].lower(), html.unescape(value))
            if self.at >= len(page) or page[self.at] == ">":
                self.at += 1
                return found
            if not m[0] and not value:  # a stray sign
                self.at += 1

    def _content(self, tag: str) -> Iterator[tuple[str, str, None]]:
        """What stands in an element whose content is no markup, and its end."""
        end = None if f"</{tag}" in self.none_left else _END[tag].search(self.page, self.at)
        if end is None:
            self.none_left.add(f"</{tag}")
        inside = self.page[self.at : end.start() if end else len(self.page)]
        if inside:
            yield "text", html.unescape(inside) if tag in DECODED else inside, None
        self.at = self._past(">", end.end()) if end else len(self.page)
        yield "end", tag, None

    def events(self) -> Iterator[tuple[str, str, dict | None]]:
        page, match = self.page, _USUAL.match
        while self.at < len(page):
            start = self.at
            m = match(page, start)
            if m:
                said, closing, tag, pairs = m.groups()
                self.at = m.end()
                if said:
                    yield "text", html.unescape(said) if "&" in said else said, None
                    continue
                tag, found = tag.lower(), fields(pairs) if pairs and not closing else {}
            else:
                after = page[start + 1 : start + 2]
                if after in ("!", "?"):
                    self.at = self._past("-->", start + 2) if page.startswith("<!--", start) else self._past(">", start)
                    yield "gap", "", None
                    continue
                closing = after == "/"
                name = _NAME.match(page, start + 1 + closing)
                if not name:
                    if closing:
                        self.at = self._past(">", start)
                        yield "gap", "", None
                    else:
                        self.at = start + 1
                        yield "text", "<", None
                    continue
                tag, self.at = name[0].lower(), name.end()
                found = self._fields(not closing)
            if closing:
                yield "end", tag, None
                continue
            yield "start", tag, found
            if tag in RAW:
                yield from self._content(tag)
