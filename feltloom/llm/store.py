"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks, so equal passages give equal
chunks wherever they stand. A chunk's address is the SHA-256 of its ids (little-endian, ``ID_TYPE``).
The store is a set of Parquet pack files in ascending doc_id order: each document's recipe (its chunk
addresses, lengths and the root of a Merkle tree over the addresses), followed by the chunks it owns: of
the documents that have a chunk, the one that was read first does. Every chunk is stored once. The
manifest seals each part: its documents, ids and roots. Reading back checks each stored chunk against its
address, each recipe against its root and each part against the manifest.

The encoded documents are staged once; who owns a chunk is decided on addresses alone (partial
minimum, so a chunk of a third of the documents is one row per task), and the payload is shuffled
once, by ranges of doc_id.

Defined results: a null text counts as empty and has the end id alone; null doc_ids come last; rows
that repeat a doc_id stand next to each other, each with its own start; an empty table gives an
empty store. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feltloom.llm.common import id_text, importable, rows_of, scratch_path, sliced, worker_cache, write_shared
from feltloom.llm.tokens import PieceCache, word_ranks

#: Ids of a chunk: least, a power of two that chunks have on average beyond it, most.
LEAST, MEAN, MOST = 128, 512, 2048
#: Ids that the rolling hash looks at.
WINDOW = 16
ID_TYPE = np.dtype("<u2")
SLICE_BYTES = 4 << 20
#: A document's number is its task's and its place there; a chunk's place is that and its place in the document.
ROW_BITS, SEQ_BITS = 23, 20
#: Recipes have sizes and digests, chunks a payload; a scan of recipes never reads payloads.
_PACK = "part int, place long, kind int, doc_id long, rid long, start long, n long, digest binary, sizes binary, digests binary, payload binary"


@functools.cache
def _mixed() -> np.ndarray:
    """A fixed random-looking 64-bit number for each id."""
    x = (np.arange(1 << 8 * ID_TYPE.itemsize, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids has its low bits clear."""
    rolled, k = _mixed()[ids], 1
    while k < WINDOW:  # sums of 2, 4, 8, 16 ids, each shifted by its distance
        rolled[k:] = rolled[k:] + (rolled[:-k] << np.uint64(k))
        k *= 2
    return np.flatnonzero((rolled >> np.uint64(20)) & np.uint64(MEAN - 1) == 0) + 1


def bounded(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids: the marks, but none within LEAST ids of the last end nor further than MOST."""
    ends, last = [], 0
    for mark in [*found, n]:
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST or mark == n and mark > last:
            ends.append(mark)
            last = mark
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    return bounded(marks(ids).tolist(), len(ids))


def cuts_of(streams: np.ndarray, ends: list[int]) -> list[list[int]]:
    """The same for many streams, one after another up to ``ends``: none of a stream's first WINDOW ids, whose
    hashes reach into the stream before, can end a chunk."""
    found, out, start = marks(streams), [], 0
    at = np.searchsorted(found, np.array(ends), side="right").tolist()
    for i, j, end in zip([0, *at], at, ends):
        out.append(bounded((found[i:j] - start).tolist(), end - start))
        start = end
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over addresses; an odd one out moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def _stage(model: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encode and chunk; words between white space encode alone, as such models drop white space."""
        compress, ranks = zstandard.ZstdCompressor(level=1).compress, word_ranks(model)
        cache = worker_cache(("words", model), lambda: PieceCache(ranks.raw, cut=False))
        rid, last, width = TaskContext.get().partitionId() << ROW_BITS, np.array([end], ID_TYPE).tobytes(), ID_TYPE.itemsize
        for batch in sliced(batches, "text", SLICE_BYTES):
            rows = []
            raws = [raw + last for raw in ranks.texts([t or "" for (t,) in rows_of(batch, "text")], cache.fill)]
            each = cuts_of(np.frombuffer(b"".join(raws), ID_TYPE), list(accumulate(len(raw) // width for raw in raws)))
            for (doc,), raw, ends in zip(rows_of(batch, "doc_id"), raws, each):
                digests = b"".join([hashlib.sha256(raw[a * width : b * width]).digest() for a, b in zip([0, *ends], ends)])
                sizes = array("i", [b - a for a, b in zip([0, *ends], ends)]).tobytes()
                rows.append((rid, doc, len(raw) // width, digests, sizes, compress(raw)))
                rid += 1
                if len(ends) >> SEQ_BITS or not rid & (1 << ROW_BITS) - 1:
                    raise ValueError("more chunks in a document or documents in a task than the store can number")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["rid", "doc_id", "n", "digests", "sizes", "payload"])

    return run


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by document: first what it owns, then the document; out come its recipe and its own chunks."""
    part, place, start, owned = TaskContext.get().partitionId(), 0, 0, {}
    decompress = zstandard.ZstdDecompressor().decompress
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in _PACK.split(", ")]
    rows, size = [], 0
    for batch in batches:
        for doc, rid, n, digests, sizes, payload, own in rows_of(batch, "doc_id", "rid", "n", "digests", "sizes", "payload", "owned"):
            if own is not None:
                owned = {rid: set(own)}
                continue
            mine = owned.get(rid, ())
            each = [digests[i : i + 32] for i in range(0, len(digests), 32)]
            rows.append((part, place, 0, doc, rid, start, n, merkle_root(each), sizes, digests, None))
            place, start = place + 1, start + n
            raw = decompress(payload) if mine else b""
            at = 0
            for i, (digest, count) in enumerate(zip(each, np.frombuffer(sizes, "<i4").tolist())):
                if i in mine:
                    rows.append((part, place, 1, doc, rid, None, count, digest, None, None, raw[at : at + count * ID_TYPE.itemsize]))
                    place += 1
                at += count * ID_TYPE.itemsize
            size += len(digests) + len(raw)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def write_store(docs: DataFrame, path: str, model: str = "word_bpe_49k.json", end: int = 2) -> None:
    """Encode ``docs`` and write the store: ``path``/packs and ``path``/manifest."""
    spark = docs.sparkSession
    staged = write_shared(id_text(docs).mapInArrow(_stage(model, end), "rid long, doc_id long, n long, digests binary, sizes binary, payload binary"), "encoded")
    refs = staged.select("doc_id", "rid", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("digests") / 32 - 1).cast("int")), lambda i: F.substring("digests", i * 32 + 1, F.lit(32)))).alias("seq", "digest"))
    # A chunk's owner: the place that was read first, one number, so that hash aggregates can find it.
    place = F.call_function("shiftleft", F.col("rid"), F.lit(SEQ_BITS)) + F.col("seq")
    first = refs.groupBy("digest").agg(F.min(place).alias("place"), F.min_by("doc_id", place).alias("doc_id"))
    owned = F.collect_list(F.col("place").bitwiseAND(F.lit((1 << SEQ_BITS) - 1)).cast("int")).alias("owned")
    owners = first.groupBy(F.shiftright("place", SEQ_BITS).alias("rid"), "doc_id").agg(owned)
    both = staged.withColumn("owned", F.lit(None).cast("array<int>")).unionByName(owners, allowMissingColumns=True)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("rid"))
    dealt = both.repartitionByRange(partitions, *order).sortWithinPartitions(*order, F.col("owned").isNull())
    dealt.select("doc_id", "rid", "n", "digests", "sizes", "payload", "owned").mapInArrow(_packs, _PACK).write.option("compression", "zstd").parquet(f"{path}/packs")
    recipes = spark.read.schema(_PACK).parquet(f"{path}/packs").where("kind = 0")
    _sealed(recipes).coalesce(1).write.parquet(f"{path}/manifest")


def _sealed(recipes: DataFrame) -> DataFrame:
    """One row for each part: how many documents and ids, and a seal over its documents' places and roots."""
    seal = F.sum(F.xxhash64("place", "n", "digest").cast("decimal(38,0)")).cast("string")
    return recipes.groupBy("part").agg(F.count("*").alias("documents"), F.sum("n").alias("ids"), seal.alias("seal"))


def _read_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Check each chunk against its address; its CRC-32 is that of the ids as 32-bit integers."""
    for batch in batches:
        rows = []
        for digest, payload in rows_of(batch, "digest", "payload"):
            if hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its address")
            ids = np.frombuffer(payload, ID_TYPE)
            rows.append((digest, crc32(ids.astype("<u4").tobytes()), len(ids)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "crc", "len"])


def _multiply(a: int, b: int) -> int:
    """a * b modulo the CRC-32 polynomial, bits reflected (bit 31 is x^0)."""
    product, m = 0, 1 << 31
    while m:
        if a & m:
            product ^= b
        m >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return product


@functools.lru_cache(maxsize=1 << 16)
def _power(n: int) -> int:
    """x to the power of n modulo the polynomial."""
    result, square = 1 << 31, 1 << 30
    while n:
        if n & 1:
            result = _multiply(result, square)
        square, n = _multiply(square, square), n >> 1
    return result


def combine_crc32(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings one after the other, from their own."""
    return (_multiply(_power(8 * second_bytes), first) if first else 0) ^ second


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for n, crcs, lengths, root, digests in rows_of(batch, "n", "crcs", "lengths", "digest", "digests"):
            if merkle_root([digests[i : i + 32] for i in range(0, len(digests), 32)]) != root:
                raise ValueError("a recipe does not match its Merkle root")
            if None in crcs:
                raise ValueError("a chunk of a recipe is not in the store")
            total, count = 0, 0
            for crc, length in zip(crcs, lengths):
                total, count = combine_crc32(total, crc, 4 * length), count + length
            if count != n:
                raise ValueError("a recipe's chunks do not add up")
            found.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(found, pa.int64())], names=["doc_id", "start", "n", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recipes with their global start, chunks, manifest) as stored."""
    importable(spark)
    packs, manifest = spark.read.schema(_PACK).parquet(f"{path}/packs"), spark.read.schema("part int, documents long, ids long, seal string").parquet(f"{path}/manifest")
    # One row a part, as many as the writer had partitions: small enough for one task and a broadcast.
    found = _sealed(packs.where("kind = 0").select("part", "place", "n", "digest")).select("part", *[F.col(c).alias(f"found_{c}") for c in ("documents", "ids", "seal")])
    same = F.col("seal").eqNullSafe(F.col("found_seal")) & F.col("documents").eqNullSafe(F.col("found_documents")) & F.col("ids").eqNullSafe(F.col("found_ids"))
    whole = manifest.join(found, "part", "full_outer").where(F.when(same, True).otherwise(F.raise_error(F.lit("a part does not match the manifest")).cast("boolean")))
    before = whole.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    recipes = packs.where("kind = 0").select("part", "rid", "doc_id", "start", "n", "digest", "digests")
    placed = recipes.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before"))
    return placed, packs.where("kind = 1").select("digest", "payload"), manifest


def _references(recipes: DataFrame) -> DataFrame:
    each = F.transform(F.sequence(F.lit(0), (F.length("digests") / 32 - 1).cast("int")), lambda i: F.substring("digests", i * 32 + 1, F.lit(32)))
    return recipes.select("rid", F.posexplode(each).alias("seq", "digest"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n, ids: the documents put together again from the store."""
    recipes, chunks, _ = read_store(spark, path)
    lists = _references(recipes).join(chunks, "digest").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("all"))
    found = recipes.join(lists, "rid")

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["payload"] for c in x), ID_TYPE).tolist() for (x,) in rows_of(batch, "all")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n", "ids"])

    return found.select("doc_id", "start", "n", "all").mapInArrow(run, "doc_id long, start long, n long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 read from the files: every stored id is read once, where it lies.

    A document's CRC-32 is combined from those of its chunks, so no payload is shuffled.
    """
    recipes, chunks, _ = read_store(spark, path)
    checked = chunks.mapInArrow(_read_chunk, "digest binary, crc long, len long")
    joined = _references(recipes).join(checked, "digest", "left")
    lists = joined.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("seq", "crc", "len"))).alias("chunks"))
    whole = recipes.join(lists, "rid")
    found = whole.select("doc_id", "start", "n", F.col("chunks.crc").alias("crcs"), F.col("chunks.len").alias("lengths"), "digest", "digests").mapInArrow(_combine, "doc_id long, start long, n long, ids_crc32 long")
    return found.select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")


def store_digests(docs: DataFrame, model: str = "word_bpe_49k.json", end: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "store")
    write_store(docs, path, model, end)
    return digests(spark, path)
