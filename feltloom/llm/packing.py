"""Packing by non-negative least squares.

A document longer than the window gives full windows and one rest. The lengths of all pieces are
counted in a histogram of ``units`` of ``GRAIN`` ids; that is all that the driver sees, 512 numbers
whatever the corpus. Shallow combinations of units that fill a window exactly (one to four pieces) are
the columns of a matrix; how often each is repeated is the non-negative least-squares solution against
the histogram, rounded down. The pieces left over are packed greedily, the largest first and the
largest that fits beside it, as long as a window gets nearly full; the few that are left after that
are laid end to end and cut at the window's borders, their last rest into powers of two, so that
nothing but the slack of the units is ever padded.

Pieces find their place without meeting: a piece's rank in its unit is its rank in its task plus what
earlier tasks have (prefix sums over counts), and ranks map to sequences in closed form. A unit that
holds a third of all rows is thus spread like any other.

Defined results: a null text counts as empty and is its end id alone; a null doc_id is returned as it
is; repeated rows are packed each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feltloom.llm.common import id_text, rows_of, vocabulary, write_shared
from feltloom.llm.tokens import byte_names, tokenizer

#: Ids of a sequence, ids of a unit, and pieces that are laid end to end together.
SEQUENCE, GRAIN, BLOCK = 2048, 4, 256
#: Least share of a window that a greedy combination must fill.
NEARLY = 0.995
_PIECE = "rid long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task long, unit int, rank long"


@cache
def _fast(model: str):
    """The vocabulary of a byte-level tokenizer file as ranks: the same ids, several times as fast."""
    import json

    import public_tokenizers
    import tiktoken

    with open(vocabulary(model), encoding="utf-8") as file:
        whole = json.load(file)
    to_byte = byte_names()
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in name): i for name, i in whole["model"]["vocab"].items() if name not in special}
    return tiktoken.Encoding(model, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(model: str, text: str) -> np.ndarray:
    try:
        return np.asarray(_fast(model).encode_to_numpy(text, allowed_special="all"), np.uint32)
    except Exception:  # its pattern engine gives up on some very long runs of white space; the library doesn't
        return np.array(tokenizer(model).encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(model: str, end: int, sequence: int, grain: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rid, ranks = task << 40, np.zeros(sequence // grain + 1, np.int64)
        names = [x.split()[0] for x in _PIECE.split(", ")] + ["payload"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in batches:
            rows = []
            for doc, text in rows_of(batch, "doc_id", "text"):
                ids = np.append(encode(model, text or ""), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), sequence):
                    own = ids[start : start + sequence]
                    unit = -(-len(own) // grain)
                    raw = own.tobytes()
                    # Only a rest can be cut again, so only a rest keeps its ids.
                    payload = None if len(own) == sequence else zstandard.compress(own.astype("<u2").tobytes() if own.max() < 65536 else raw, 3)
                    rows.append((rid, doc, start, len(own), crc32(raw), len(ids), task, unit, int(ranks[unit]), payload))
                    ranks[unit] += 1
                    rid += 1
            for some in (rows[i : i + 5000] for i in range(0, len(rows), 5000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

    return run


def combinations(units: int) -> list[tuple[int, ...]]:
    """Shallow combinations, largest first, that fill ``units`` exactly: all of one to three pieces, and
    of four those on a grid of an eighth of that precision."""
    found: list[tuple[int, ...]] = [(units,)]
    found += [(units - a, a) for a in range(1, units // 2 + 1)]
    found += [(units - a - b, b, a) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    step = max(1, units // 64)
    g = units // step
    if g * step == units:
        found += [tuple(step * x for x in (g - a - b - c, c, b, a)) for a in range(1, g // 4 + 1) for b in range(a, (g - a) // 3 + 1) for c in range(b, (g - a - b) // 2 + 1)]
    return found


def solve(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often to repeat each combination."""
    parts = [tuple((u, col.count(u)) for u in set(col)) for col in columns]
    norms = [sum(n * n for _, n in p) for p in parts]
    rest, x = histogram.astype(float).tolist(), [0.0] * len(columns)
    scale = max(1.0, float(histogram.sum()))
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            gradient = 0.0
            for u, n in p:
                gradient += n * rest[u]
            old = x[j]
            new = old + gradient / norms[j]
            if new < 0.0:
                new = 0.0
            if new != old:
                x[j], change = new, new - old
                for u, n in p:
                    rest[u] -= n * change
                moved += abs(change)
        if moved < 1e-3 * scale / SEQUENCE:
            break
    return np.array(x)


def plan(histogram: np.ndarray, nearly: float = NEARLY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """([(combination, repeats)], pieces left per unit) from the counts of pieces by unit (index 0 unused)."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(combination: tuple[int, ...], repeats: int) -> None:
        repeats = min([repeats, *(int(left[u]) // combination.count(u) for u in set(combination))])
        if repeats > 0:
            chosen.append((combination, repeats))
            for u in combination:
                left[u] -= repeats

    take((units,), int(left[units]))
    columns = [c for c in combinations(units)[1:] if all(left[u] for u in c)]
    if columns:
        x = solve(columns, left)
        for j in np.argsort(-x, kind="stable"):
            take(columns[j], int(x[j]))
    # Greedy: the largest unit, then again and again the largest that still fits.
    skipped = np.zeros(units + 1, bool)
    for largest in range(units, 0, -1):
        while left[largest] and not skipped[largest]:
            counts, combination, room = left.copy(), [], units
            u = largest
            while u > 0:
                n = min(int(counts[u]), room // u)
                combination += [u] * n
                room -= n * u
                u = min(u - 1, room)
            if units - room < nearly * units:
                skipped[largest] = True
            else:
                repeats = min(int(left[u]) // combination.count(u) for u in set(combination))
                take(tuple(combination), max(1, repeats))
    return chosen, left


def _cut():
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The CRC-32 of the ids of each part of a cut piece."""
        for batch in batches:
            found = []
            for payload, length, first, size in rows_of(batch, "payload", "length", "first", "size"):
                raw = zstandard.decompress(payload)
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4")
                found.append(crc32(ids[first : first + size].tobytes()))
            i = batch.schema.get_field_index("ids_crc32")
            keep = [n for n in batch.schema.names if n != "payload"]
            columns = [pa.array(found, pa.int64()) if batch.schema.get_field_index(n) == i else batch.column(batch.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays(columns, names=keep)

    return run


def pack(docs: DataFrame, model: str = "byte_bpe_50k.json", end: int = 1, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    staged = write_shared(id_text(docs).mapInArrow(_pieces(model, end, sequence, grain), f"{_PIECE}, payload binary"), "pieces")
    counts = staged.groupBy("unit", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(sequence // grain + 1, np.int64)
    for unit, n in counts.groupBy("unit").agg(F.sum("n")).collect():  # one row a unit
        histogram[unit] = n
    chosen, left = plan(histogram)
    # Ranges of ranks: (unit, from, up to, first sequence, slot); bounded by the combinations of the plan.
    ranges, used, sequences = [], np.zeros(len(histogram), np.int64), 0
    for combination, repeats in chosen:
        for slot, unit in enumerate(combination):
            ranges.append((int(unit), int(used[unit]), int(used[unit]) + repeats, sequences, slot, False))
            used[unit] += repeats
        sequences += repeats
    laid = 0
    for unit in range(len(left) - 1, 0, -1):  # what is left lies end to end, the largest units first
        if left[unit]:
            ranges.append((unit, int(used[unit]), int(used[unit] + left[unit]), laid, 0, True))
            laid += int(left[unit])
    table = spark.createDataFrame(ranges, "unit int, low long, high long, base long, slot int, rest boolean")
    before = counts.select("unit", "task", (F.sum("n").over(Window.partitionBy("unit").orderBy("task")) - F.col("n")).alias("before"))
    ranked = staged.drop("payload").join(before, ["unit", "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")
    placed = ranked.join(F.broadcast(table), "unit").where("rank >= low and rank < high").withColumn("at", F.col("base") + F.col("rank") - F.col("low"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    slots = Window.partitionBy("at").orderBy("slot")
    whole = placed.where("not rest").withColumn("offset", F.sum("length").over(slots) - F.col("length")).withColumnRenamed("at", "sequence_id").select(*names)

    # End to end within blocks of BLOCK pieces. The borders of a block: multiples of the sequence, and
    # after the last whole one the powers of two that its rest is the sum of.
    rest = placed.where("rest").withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
    line = Window.partitionBy("block")
    lying = rest.withColumn("low", F.sum("length").over(line.orderBy("at")) - F.col("length")).withColumn("total", F.sum("length").over(line))
    full = F.floor(F.col("total") / sequence).cast("long") * sequence
    bits = F.transform(F.sequence(F.lit(0), F.lit(sequence.bit_length() - 2)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    remainder = F.col("total") - full
    # After the bits above b: full + the remainder without its bits below 2 * b.
    steps = F.transform(F.filter(bits, lambda b: remainder.bitwiseAND(b) > 0), lambda b: full + remainder - F.pmod(remainder, b))
    borders = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / sequence).cast("long")), lambda i: i * sequence), steps))
    inside = F.array_sort(F.filter(borders, lambda b: (b > F.col("low")) & (b < F.col("low") + F.col("length"))))
    firsts = F.concat(F.array(F.col("low")), inside)
    cut = lying.withColumn("borders", F.filter(borders, lambda b: b <= F.col("low") + F.col("length"))).withColumn("firsts", firsts)
    parts = cut.select("*", F.posexplode("firsts").alias("k", "begin")).withColumn("stop", F.coalesce(F.get("firsts", F.col("k") + 1), F.col("low") + F.col("length")))
    home = F.array_max(F.filter("borders", lambda b: b <= F.col("begin")))
    # A block has at most BLOCK whole sequences and one for each bit of its rest.
    number = sequences + F.col("block") * (BLOCK + 64) + F.size(F.filter("borders", lambda b: b <= F.col("begin")))
    parts = parts.select(
        "rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.size("firsts").alias("n"), (F.col("begin") - F.col("low")).cast("int").alias("first"),
        (F.col("stop") - F.col("begin")).cast("int").alias("size"), number.cast("long").alias("sequence_id"), (F.col("begin") - home).alias("offset"),
    )
    uncut = parts.where("n = 1").select(*names)
    ids = staged.where("payload is not null").select("rid", "payload")
    schema = "rid long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, n int, first int, size int, sequence_id long, offset long"
    again = parts.where("n > 1").join(ids, "rid").select(*[c.split()[0] for c in schema.split(", ")], "payload").mapInArrow(_cut(), schema)
    recut = again.select("doc_id", (F.col("start") + F.col("first")).alias("start"), F.col("size").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
    every = whole.unionByName(uncut).unionByName(recut)
    return every.select(*[F.col(c).cast("long").alias(c) for c in names])


def sequences(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """sequence_id, ids: what a trainer reads, from ``pack`` and the documents' ids (doc_id unique, ids array<int>)."""
    cut = pieces.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part"))
    found = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return found.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("ids"))
