"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pass one cuts every text with the public pattern. The pre-tokens of a block of documents become a
dictionary of that block and, for each document, its positions: the index of each pre-token in that
dictionary, in order, compressed. They are written once, bucketed by block, so that they never need a
shuffle. The dictionaries are exploded by word and shuffled: every distinct word of the corpus meets
in one word bucket, where it is encoded once, and its ids are joined back to every block that has it.
Each block then puts its documents together again by position; decoding looks each id up in the
token-byte table (its size is the vocabulary's). A word that fills a third of the corpus is one entry
of each block, so no key is hot.

Defined results: a null text counts as empty (no tokens, the digests of nothing); a null doc_id is
returned as it is; rows are kept apart even if repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.llm.common import id_text, rows_of, scratch_table, sliced
from feltloom.llm.tokens import rank_encoding

#: Bytes of text in a block: it bounds the dictionary and the memory that puts a block together.
BLOCK_BYTES = 12 << 20
_CUT = {"block": pa.int64(), "bucket": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "payload": pa.binary()}


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed: high bytes are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def _pack(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack(data: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return parts


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def _cut(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (bucket null), and one for each word bucket of the block's dictionary."""
        import public_tokenizers
        import regex

        find = regex.compile(public_tokenizers.PATTERN).findall
        block = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "text", BLOCK_BYTES):
            index: dict[str, int] = {}
            rows = []
            for doc, text in rows_of(batch, "doc_id", "text"):
                at = np.array([index.setdefault(w, len(index)) for w in find(text or "")], np.uint32)
                rows.append((block, None, doc, len(at), _planes(at)))
            words = [w.encode() for w in index]
            bucket = np.array([crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(some):
                    own = [words[i] for i in some.tolist()]
                    payload = _pack(_planes(np.diff(some, prepend=0)), _planes(np.array([len(w) for w in own])), zstandard.compress(b"".join(own), 3))
                    rows.append((block, int(bucket[some[0]]), None, len(own), payload))
            block += 1
            for some in (rows[i : i + 1000] for i in range(0, len(rows), 1000)):
                yield _batch(some, _CUT)

    return run


def _encode(model: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: each distinct word is encoded once, and its ids go back to its blocks."""
        encode = rank_encoding(model)._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            for block, bucket, n, payload in rows_of(batch, "block", "bucket", "n", "payload"):
                if bucket != last:
                    known, last = {}, bucket
                at, sizes, raw = _unpack(payload)
                raw, ends = zstandard.decompress(raw), np.cumsum(_numbers(sizes), dtype=np.int64).tolist()
                ids = []
                for a, b in zip([0, *ends], ends):
                    word = raw[a:b]
                    if (found := known.get(word)) is None:
                        found = known[word] = encode(word)
                    ids.append(found)
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                yield _batch([(block, n, _pack(at, _planes(np.array([len(x) for x in ids])), _planes(flat)))], {"block": pa.int64(), "n": pa.int64(), "payload": pa.binary()})

    return run


def token_bytes(model: str) -> list[bytes]:
    """The token-byte table, by token."""
    ranks = rank_encoding(model)._mergeable_ranks
    table = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return table


def _assemble(model: str):
    def run(parts: pa.Table, words: pa.Table) -> pa.Table:
        """The documents of one block, from their positions and the ids of the block's words."""
        table = token_bytes(model)
        total = sum(words.column("n").to_pylist())
        texts, pieces, sizes = [""] * total, [b""] * total, np.zeros(total, np.int64)
        for payload in words.column("payload").to_pylist():
            at, counts, ids = map(_numbers, _unpack(payload))
            where = np.cumsum(at, dtype=np.int64)
            sizes[where] = counts
            ids, end = ids.tolist(), 0
            for i, n in zip(where.tolist(), counts.tolist()):
                own = ids[end : end + n]
                end += n
                texts[i] = " ".join(map(str, own))
                pieces[i] = b"".join([table[t] for t in own])
        rows = []
        for doc, payload in zip(parts.column("doc_id").to_pylist(), parts.column("payload").to_pylist()):
            at = _numbers(payload)
            where = at.tolist()
            ids, decoded = " ".join([texts[i] for i in where]).encode(), b"".join([pieces[i] for i in where])
            rows.append((doc, int(sizes[at].sum()), ids, decoded))
        return pa.table(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return run


def encode_decode(docs: DataFrame, model: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = scratch_table(spark, "words")
    cut = id_text(docs).mapInArrow(_cut(partitions), "block long, bucket int, doc_id long, n long, payload binary")
    # A bucketed table in the shared warehouse: the later meeting by block reads it in place.
    cut.write.bucketBy(partitions, "block").option("compression", "zstd").saveAsTable(name)
    staged = spark.table(name)
    words = staged.where("bucket is not null").select("block", "bucket", "n", "payload").repartition(partitions, "bucket")
    ids = words.sortWithinPartitions("bucket").mapInArrow(_encode(model), "block long, n long, payload binary")
    parts = staged.where("bucket is null").select("block", "doc_id", "payload")
    return parts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
