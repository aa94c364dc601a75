"""Encoding through the public vocabularies, with bounded caches in each Python worker."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from feltloom.llm.common import vocabulary  # noqa: E402

#: Entries of one generation of a worker's cache; two generations are held at most.
CACHE_ENTRIES = 250_000


@functools.cache
def tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@functools.cache
def rank_encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary(name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def halves(piece: str) -> tuple[str, str]:
    """A word and the full stop or comma after it; these are pre-tokens of their own in every vocabulary here."""
    word = piece[:-1]
    if piece[-1:] in (".", ",") and (word[1:] if word[:1] == " " else word).isalpha():
        return word, piece[-1]
    return piece, ""


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordRanks:
    """Ids of many words by a vocabulary of lower-case words with word ends, several times as fast as the library.

    The merges of such a file are in the order of their ids, after the bytes and the bytes that end a
    word, so its tokens are ranks, once the character NUL stands for the end of a word. Words are encoded in
    one call, and where they end is read off their last tokens.
    Pieces that normalisation could change in other ways than to lower case go to the library itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "\x00"

    def __init__(self, name: str):
        import json

        import regex
        import tiktoken

        with open(vocabulary(name), encoding="utf-8") as file:
            whole = json.load(file)
        byte, special = byte_names(), {t["content"] for t in whole["added_tokens"]}
        vocab, suffix = whole["model"]["vocab"], whole["model"]["end_of_word_suffix"]
        for i, merge in enumerate(whole["model"]["merges"]):
            if vocab["".join(merge if isinstance(merge, list) else merge.split(" "))] != 512 + i:
                raise ValueError(f"the merges of {name} are not in the order of their ids")
        end, ranks = self.END.encode(), {}
        self.ends = np.zeros(len(vocab), bool)
        for token, i in vocab.items():
            if token not in special:
                closes = token.endswith(suffix)
                name_of = bytes(byte[c] for c in (token[: -len(suffix)] if closes else token))
                if end in name_of and len(name_of) > 1:
                    raise ValueError(f"{name} has a token with NUL among other bytes")
                ranks[name_of + (end if closes else b"")] = i
                self.ends[i] = closes
        self.name, self.find = name, regex.compile(self.PATTERN).findall
        self.encoding = tiktoken.Encoding(name, pat_str=f"[^{self.END}]+{self.END}", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _joined(text: str) -> str | None:
        """The words of a plain text between spaces, or None: letters of Latin-1, white space, and lone full stops and commas."""
        low = text.lower()
        if not low.replace(" ", "").replace("\n", "").replace(".", "").replace(",", "").isalpha() or ".." in low or ",," in low or ".," in low or ",." in low:
            return None
        if not low.isascii():
            try:
                low.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return low.replace(".", " . ").replace(",", " , ").replace("\n", " ")

    def _plain(self, joined: list[str]) -> list[bytes]:
        """The ids of plain texts: each distinct word of all of them is encoded once, and laid out by place."""
        lists = pc.split_pattern(pa.array(joined, pa.string()), " ")
        coded = lists.values.dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        counts, ids = np.zeros(len(names), np.int64), np.zeros(0, np.uint32)
        if words := [n for n in names if n]:
            ids = np.asarray(self.encoding.encode_to_numpy(self.END.join(words) + self.END, disallowed_special=()))
            counts[[i for i, n in enumerate(names) if n]] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        begin, each = np.cumsum(counts) - counts, counts[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(ends[-1]) + np.repeat(begin[index] - ends[:-1], each)
        stream, cuts = ids[at].astype("<u2").tobytes(), (2 * ends[lists.offsets.to_numpy()]).tolist()
        return [stream[a:b] for a, b in zip(cuts, cuts[1:])]

    def texts(self, texts: list[str], fill: Callable[[list[str]], Callable[[str], bytes]]) -> list[bytes]:
        """The ids of whole texts as little-endian 16-bit integers. Plain texts, and plain lines of the others,
        are encoded together; the pieces between the spaces of what is left are looked up through ``fill``."""
        units, owner = [], []
        for i, text in enumerate(texts):
            joined = self._joined(text)
            own = [(text, joined)] if joined is not None or "\n" not in text else [(line, self._joined(line)) for line in text.split("\n") if line]
            units += own
            owner += [i] * len(own)
        plain = [joined for _, joined in units if joined is not None]
        ready = iter(self._plain(plain) if plain else ())
        others = [text.split(" ") for text, joined in units if joined is None]
        rest, get = iter(others), fill([p for words in others for p in words])
        out: list[list[bytes]] = [[] for _ in texts]
        for i, (_, joined) in zip(owner, units):
            out[i].append(next(ready) if joined is not None else b"".join(map(get, next(rest))))
        return [b"".join(parts) for parts in out]

    def raw(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 16-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        where, words, counts = [], [], []
        for i, piece in enumerate(pieces):
            if piece.isprintable() and "<|" not in piece and (piece.isascii() or max(piece) < "\u0250"):
                low = piece.lower()
                if low.isalpha():
                    words.append(low)
                    counts.append(1)
                elif low[:-1].isalpha() and low[-1] in ".,":
                    words += (low[:-1], low[-1])
                    counts.append(2)
                else:
                    found = self.find(low)
                    words += found
                    counts.append(len(found))
                where.append(i)
        rest = [i for i, piece in enumerate(pieces) if out[i] is None] if len(where) < len(pieces) else []
        if words:
            ids = np.asarray(self.encoding.encode_to_numpy(self.END.join(words) + self.END, disallowed_special=()))
            closing = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            at = (2 * closing[np.cumsum([0, *counts])]).tolist()
            flat = ids.astype("<u2").tobytes()
            for i, a, b in zip(where, at, at[1:]):
                out[i] = flat[a:b]
        else:
            for i in where:
                out[i] = b""
        odd = [i for i in rest if out[i] is None]
        if odd:
            for i, e in zip(odd, tokenizer(self.name).encode_batch_fast([pieces[i] for i in odd], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u2").tobytes()
        return out


@functools.cache
def word_ranks(name: str) -> WordRanks:
    return WordRanks(name)


class PieceCache:
    """piece -> value with two generations: when the young one is full it becomes the old one.

    ``fixed`` is the first tier, a table that stays for good; the generations are the second. What
    both lack is cut into a word and what follows it, whose values are added (unless ``cut`` is false).
    """

    def __init__(self, encode: Callable[[list[str]], list], entries: int = CACHE_ENTRIES, fixed: dict | None = None, cut: bool = True):
        self.encode, self.entries, self.fixed, self.cut = encode, entries, fixed or {}, cut
        self.young: dict = dict(self.fixed)
        self.old: dict = {}

    def fill(self, pieces: Iterable[str]) -> Callable[[str], object]:
        """Look up or encode all of ``pieces``; returns the lookup, good until the next call."""
        if len(self.young) > self.entries + len(self.fixed):
            self.old, self.young = self.young, dict(self.fixed)
        young, old = self.young, self.old
        missing = {piece for piece in pieces if piece not in young}
        if old and (kept := [piece for piece in missing if piece in old]):
            young.update((piece, old[piece]) for piece in kept)
            missing.difference_update(kept)
        if missing and not self.cut:
            missing = list(missing)
            young.update(zip(missing, self.encode(missing)))
        elif missing:
            parts = {piece: halves(piece) for piece in missing}
            words = {w for both in parts.values() for w in both if w}.difference(young)
            if old and (kept := [word for word in words if word in old]):
                young.update((word, old[word]) for word in kept)
                words.difference_update(kept)
            words = list(words)
            young.update(zip(words, self.encode(words)))
            for piece, (word, tail) in parts.items():
                if tail:
                    young[piece] = young[word] + young[tail]
                elif not piece:
                    young[piece] = self.encode([""])[0]
        return young.__getitem__


_OTHER_SPACE = re.compile(r"[^\S \n]|\x00")


def safe_split(text: str) -> list[str] | None:
    """Cut a text before single spaces and around single line feeds, or None where that could change tokens.

    The byte-level pattern takes one space along with the run after it and a lone line feed by
    itself, so between two characters that aren't white space these cuts fall on its own borders.
    """
    if not text:
        return []
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
        return None
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
