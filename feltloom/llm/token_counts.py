"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-token pieces and their token counts, fitted on a bounded
sample of documents and broadcast (``TABLE_ENTRIES`` entries of at most ``PIECE_BYTES`` bytes: under
2 MB whatever the corpus). Tier two is a bounded cache in each worker; what neither holds is encoded
by the library. The tables only save time: every count is the library's own, and no pre-token is
ever shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is returned as it is;
repeated rows are counted each; an empty table gives an empty result. Texts with white space other
than single spaces and line feeds, where pieces could straddle a pre-token, are encoded whole.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.llm.common import Shared, id_text, rows_of, sliced, worker_cache
from feltloom.llm.sampling import bounded_ids
from feltloom.llm.tokens import PieceCache, safe_split, tokenizer

#: The bounded sample that the frequent pieces are taken from, and the size of the table.
SAMPLE_DOCUMENTS, TABLE_ENTRIES, PIECE_BYTES = 1000, 32_768, 48
#: Bytes of text handled at a time.
SLICE_BYTES = 2 << 20


def lengths(model: str, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer(model).encode_batch_fast(texts, add_special_tokens=False)]


class FrequentLengths:
    """Sorted pieces in one byte string, their ends and their token counts: what is broadcast."""

    def __init__(self, counts: dict[str, int]):
        pieces = sorted(counts)
        raw = [p.encode() for p in pieces]
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.uint32)
        self.raw, self.counts = b"".join(raw), np.array([counts[p] for p in pieces], dtype=np.uint16)

    def table(self) -> dict[str, int]:
        ends = self.ends.tolist()
        return {self.raw[a:b].decode(): n for a, b, n in zip([0, *ends], ends, self.counts.tolist())}


def frequent_lengths(docs: DataFrame, model: str, sample: int = SAMPLE_DOCUMENTS, entries: int = TABLE_ENTRIES) -> FrequentLengths:
    """Fit the first tier on ``sample`` documents, those of the smallest hashed ids."""
    ids = bounded_ids(docs, sample)
    seen: Counter = Counter()
    # At most ``sample`` ids are broadcast; of each of their texts 8 KB are enough for the table.
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.substring("text", 1, 8192)).limit(2 * sample)
    for (text,) in texts.collect():
        seen.update(safe_split((text or "").strip()) or ())
    pieces = [p for p, n in seen.most_common(entries) if n > 1 and len(p.encode()) <= PIECE_BYTES]
    return FrequentLengths(dict(zip(pieces, lengths(model, pieces))) if pieces else {})


def _count(model: str, frequent: Shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(("counts", model, frequent.key), lambda: PieceCache(functools.partial(lengths, model), fixed=frequent.value.table()))
        for batch in sliced(batches, "text", SLICE_BYTES):
            texts = ["" if t is None else t for (t,) in rows_of(batch, "text")]
            cut = [safe_split(t) for t in texts]
            get = cache.fill(p for c in cut if c for p in c)
            whole = iter(lengths(model, [t for t, c in zip(texts, cut) if c is None]))
            n = [next(whole) if c is None else sum(map(get, c)) for c in cut]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    rows = id_text(docs)
    frequent = Shared(docs.sparkSession, frequent_lengths(rows, model))
    counted = rows.mapInArrow(_count(model, frequent), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
