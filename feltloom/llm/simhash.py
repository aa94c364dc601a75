"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius (one flipped bit: 65 variants);
two fingerprints at most two bits apart share a variant. The variants are shuffled, and since all
distinct fingerprints that meet at a variant lie within one bit of it, at most 65 meet and every two of
them are linked: a star from the smallest of them says as much as all pairs. Edges are deduplicated
and verified with a bit count. Copies share a fingerprint and are merged before anything is emitted.
Components come from alternating large and small stars, each round written to the shared folder.

Fingerprints: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, 3-word shingles with
repeats, joined by a space (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if more
than half of the hashes have it.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; a null
doc_id is no component_id unless its whole component has none; repeated rows are returned each; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feltloom.llm.common import id_text, keep_rows, rows_of, write_shared

SHINGLE, SEED = 3, 42


def hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[shingle:])], np.uint64)


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint."""
    return packed(hashes(text or ""))


def packed(h: np.ndarray) -> int:
    """The signed fingerprint of shingle hashes: of each bit, whether more than half of them have it."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        counts += np.unpackbits(h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for (t,) in rows_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (which tells rows of one doc_id apart), fp."""
    rows = id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """lo, hi: verified edges that connect all of the distinct fingerprints ``fp`` up to 2 bits apart."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = distinct.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("variant"))
    met = ball.select(F.col("fp").alias("hi"), F.min("fp").over(Window.partitionBy("variant")).alias("lo"))
    edges = met.where("hi > lo").distinct()
    return edges.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= 2)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (lo, hi) but the roots.

    Alternating stars: after few rounds every component is a star around its smallest node. The
    smallest neighbour of a node is found by a partial aggregate, so a hub is no hot key.
    """
    now = write_shared(edges, "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
        both = now.select("lo", "hi").union(now.select("hi", "lo")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("least", "node").alias("least"))
        # Large star: every larger neighbour moves to the smallest one.
        large = both.where("other > node").join(least, "node").select(F.col("least").alias("lo"), F.col("other").alias("hi")).where("lo < hi").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        small = large.groupBy("hi").agg(F.min("lo").alias("least"))
        moved = large.join(small, "hi")
        now = write_shared(
            moved.select(F.col("least").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").union(small.select(F.col("least").alias("lo"), "hi")).distinct(), "edges"
        )


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp of every document; fp, root, component_id of every distinct fingerprint)."""
    rows = write_shared(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(distinct.select("fp")))
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows, classed.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document."""
    rows, by_print = classes(docs)
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash: of each component the row that stays, that of the smallest doc_id (null last)."""
    rows, by_print = classes(docs)
    # The smallest row of each fingerprint first: a hot fingerprint is one row per task before the join.
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row"))
    best = least.join(by_print.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    return best.select("row.doc_id", "row.text_hash")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, one row of each component."""
    return keep_rows(docs, F.xxhash64(F.col("text").cast("string")), representatives(docs))
