"""Exact deduplication by Patricia-trie owners.

Texts are compared after deleting the white space ``[\\x20\\x09-\\x0D]``. Every map task first merges
its own rows in a trie, so a text copied millions of times leaves each task once. The distinct
strings are then dealt out by (length, content hash); each partition inserts the full byte strings
into a compressed radix trie whose terminal nodes keep the best row (most code points in the
original, then smallest doc_id) and the number of rows. A trie that outgrows its budget spills whole
subtrees to the task's own temporary files and finishes them one after another.
The members are joined to their owner by the digest of the normalised text.

Defined results: a null text counts as empty; all empty texts are one group. A null doc_id sorts
after every other. Rows that repeat both doc_id and text: exactly one is kept. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltloom.llm.common import WHITE, WHITE_BYTES, id_text, keep_rows, worker_cache

#: Bytes of strings that one trie may hold before it is flushed (map side) or spills (owner side).
TRIE_BYTES = 48 << 20


class _Node:
    __slots__ = ("key", "start", "end", "children", "value", "spill")

    def __init__(self, key: bytes, start: int, end: int):
        self.key, self.start, self.end = key, start, end
        self.children: dict[int, _Node] = {}
        self.value = None
        self.spill = None


def _common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common prefix of a[i:i+most] and b[j:j+most], by bisection."""
    if a[i : i + most] == b[j : j + most]:
        return most
    low, high, step = 0, most, 16
    while low + step < high and a[i + low : i + low + step] == b[j + low : j + low + step]:
        low, step = low + step, step * 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, doc_id or None): the row that stays."""
    return min(a, b, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


class PatriciaTrie:
    """A compressed radix trie over byte strings; a value is (code points, doc_id, rows)."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.budget, self.bytes, self.spilled = _Node(b"", 0, 0), budget, 0, []

    def insert(self, key: bytes, value: tuple) -> None:
        node, pos, n = self.root, 0, len(key)
        while True:
            if node.spill is not None:
                pickle.dump((key, value), node.spill)
                return
            if pos == n:
                if node.value is None:
                    node.value = value
                    if node.key is not key:
                        self.bytes += 200
                else:
                    node.value = (*better(node.value[:2], value[:2]), node.value[2] + value[2])
                break
            child = node.children.get(key[pos])
            if child is None:
                leaf = node.children[key[pos]] = _Node(key, pos, n)
                leaf.value = value
                self.bytes += n + 400
                break
            size = child.end - child.start
            same = _common(key, pos, child.key, child.start, min(size, n - pos))
            if same < size:
                middle = _Node(child.key, child.start, child.start + same)
                child.start += same
                middle.children[child.key[child.start]] = child
                node.children[key[pos]] = middle
                child = middle
            node, pos = child, pos + same
        if self.budget and self.bytes > self.budget:
            self._spill()

    def _entries(self, node: _Node, path: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            if node.value is not None:
                yield path, node.value
            for child in node.children.values():
                if child.spill is None:
                    stack.append((child, path + child.key[child.start : child.end]))

    def _spills(self, node: _Node) -> Iterator:
        stack = [node]
        while stack:
            node = stack.pop()
            if node.spill is not None:
                yield node.spill
            stack.extend(node.children.values())

    def _spill(self) -> None:
        """Move the largest subtree below the first branching node to a file."""
        node, path = self.root, b""
        while len(node.children) == 1 and node.value is None:
            node = next(iter(node.children.values()))
            if node.spill is not None:
                return
            path += node.key[node.start : node.end]
        sizes = {}
        for first, child in node.children.items():
            if child.spill is None:
                sizes[first] = sum(len(k) + 400 for k, _ in self._entries(child, path + child.key[child.start : child.end]))
        if not sizes or len(node.children) + (node.value is not None) < 2:
            return
        first = max(sizes, key=sizes.get)
        child = node.children[first]
        out = tempfile.TemporaryFile()
        for entry in self._entries(child, path + child.key[child.start : child.end]):
            pickle.dump(entry, out)
        for inner in self._spills(child):  # what had spilled below it moves along, so a key is in one file only
            inner.seek(0)
            shutil.copyfileobj(inner, out)
            inner.close()
            self.spilled.remove(inner)
        gone = _Node(bytes([first]), 0, 1)
        gone.spill = out
        node.children[first] = gone
        self.spilled.append(out)
        self.bytes -= sizes[first]

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        yield from self._entries(self.root, b"")
        self.root.children = {}
        for file in self.spilled:
            file.seek(0)
            part = PatriciaTrie(self.budget)
            while True:
                try:
                    part.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from part.items()


def _emit(entries: Iterable[tuple[bytes, tuple]], owners: bool) -> Iterator[pa.RecordBatch]:
    """Record batches of a few MB: candidates with their full string, or owners with its digest."""
    rows, size = [], 0
    for key, (chars, doc, n) in entries:
        first = (hashlib.sha256(key).hexdigest(),) if owners else (len(key), xxhash.xxh64_intdigest(key) - (1 << 63), key)
        rows.append((*first, chars, doc, n))
        size += 100 if owners else len(key) + 100
        if size > 4 << 20:
            yield _batch(rows, owners)
            rows, size = [], 0
    if rows:
        yield _batch(rows, owners)


def _batch(rows: list[tuple], owners: bool) -> pa.RecordBatch:
    names = (["text_sha256"] if owners else ["norm_len", "norm_hash", "norm"]) + ["best_chars", "keep_id", "n"]
    kinds = ([pa.string()] if owners else [pa.int64(), pa.int64(), pa.binary()]) + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _candidates(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(("exact_dedup",), lambda: None)  # what an earlier operator kept goes
        trie = PatriciaTrie(0)
        for batch in batches:
            for doc, text, chars in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert((text or b"").translate(None, WHITE_BYTES), (chars, doc, 1))
                if trie.bytes > budget:
                    yield from _emit(trie.items(), False)
                    trie = PatriciaTrie(0)
        yield from _emit(trie.items(), False)

    return run


def _owners(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for batch in batches:
            for norm, chars, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(norm, (chars, doc, n))
        yield from _emit(trie.items(), True)

    return run


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """text_sha256, best_chars, keep_id, n: one row per distinct normalised text."""
    rows = id_text(docs).select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")
    )
    found = rows.mapInArrow(_candidates(trie_bytes), "norm_len long, norm_hash long, norm binary, best_chars long, keep_id long, n long")
    dealt = found.repartition("norm_len", "norm_hash").select("norm", "best_chars", "keep_id", "n")
    return dealt.mapInArrow(_owners(trie_bytes), "text_sha256 string, best_chars long, keep_id long, n long")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "").cast("binary"), 256)


def drop_exact_duplicates(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs``, one row of each group of equal texts."""
    best = owners(docs, trie_bytes).select(F.col("keep_id").alias("doc_id"), F.xxhash64("text_sha256", "best_chars").alias("text_hash"))
    chars = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return keep_rows(docs, F.xxhash64(digest(F.col("text")), chars), best)


def exact_dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chars: one row per document."""
    members = id_text(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), digest(F.col("text")).alias("text_sha256"))
    # The explicit repartition lets AQE split a hot digest in the join below it.
    joined = members.join(owners(docs, trie_bytes), "text_sha256").repartition("doc_id")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("n_chars")))
    return joined.withColumn("first", first).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (best & (F.col("first") == 1)).alias("kept"), "text_sha256", "n_chars"
    )
