"""Near copies of a given similarity: SimHash balls first, an exact join for what they cannot reach.

Two texts are near copies if their sets of ``WORDS``-word shingles have a Jaccard similarity of 0.8 or
more; components of near copies keep one row. The balls of ``simhash`` reach fingerprints two bits apart, which most
texts of that similarity are not (their fingerprints differ in about ten of 64 bits, too far for any ball that can be
emitted), so pairs that the balls find are verified and linked, and the rest comes from a join by prefixes: with the
shingles of every set in one global order, two sets of that similarity share one of the first ``n - ceil(0.8 n) + 1``
shingles of each, so only sets that meet there are compared, and these exactly. Any order gives the same result. The
one used puts shingles that repeat in a bounded sample last, so that common passages seldom lead.
A meeting counts only if the sizes, and what follows of both sets after the first shingle that they share, allow the similarity.

Sets that meet at a shingle are first compared with one of them, at first that in which fewest shingles come before it (what
the others were edited from, as edits make rare shingles), and anew as long as that links many; then
every two that are still of different components are compared. So no pair is left out, while a large
group of near copies costs few comparisons a member; where many sets still meet, the last comparison looks at their bitmaps at
once, so that only pairs that may be similar come out of it. Before any text is sent for, a pair's parity bitmaps
(``PARITY`` bits, each the parity of the shingles hashed to it) are compared: they differ in no more bits than the sets in
shingles, so a pair whose bitmaps differ in over a ninth of both sizes is not similar. Sets of more shingles than that fill
such a bitmap, so what is left of their pairs is compared by bitmaps as wide as the sets are large. Copies have one set and are merged beforehand. Shingles that hold
more than a small share of the sample never meet in one task: their centres come from partial aggregates.

Shingles: words as in ``simhash``; fewer words than a shingle has are one shingle. A null, empty or blank
text has the empty set, which is similar to itself alone. Null doc_ids come last; an empty table gives an
empty result. Extra columns are carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltloom.llm.common import Shared, drop_rows, few, id_text, rows_of, sliced, worker_cache, write_shared
from feltloom.llm.sampling import SLOTS
from feltloom.llm.simhash import components, hashes, links, packed

WORDS = 5
#: Sets of the sample that orders shingles, shingles that it puts last at most.
SAMPLE, COMMON = 4000, 50_000
#: Bytes of text handled at a time.
SLICE_BYTES = 2 << 20
#: Bits of a set's parity bitmap.
PARITY = 1024
#: Of this many sets of the sample on, a shingle is heavy; pairs of a centre that one task compares.
HEAVY, PAIRS = 20, 500
#: A round of stars that links fewer is the last.
FEW = 1000
#: Of more sets that meet at a shingle, the bitmaps go along into the last comparison.
CROWD = 8


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(hashes(text or "", WORDS)).view(np.int64)


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles by (count in the sample, hash)."""
    n = len(grams)
    if not n:
        return grams
    order = np.arange(n)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        order = np.argsort(np.where(common[at] == grams, counts[at], 0), kind="stable")
    return grams[order[: n - (4 * n + 4) // 5 + 1]]


def parity(grams: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """The bitmap as 64-bit numbers."""
    odd = np.bincount((grams.view(np.uint64) % np.uint64(bits)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def wide_parity(grams: np.ndarray) -> np.ndarray:
    """A bitmap of the next power of two from the set's size on, empty if the plain one is as wide."""
    bits = 1 << max(0, len(grams) - 1).bit_length()
    return parity(grams, bits) if bits > PARITY else np.zeros(0, np.int64)


def _differ(x: Column, y: Column) -> Column:
    """In how many bits two bitmaps of one width differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def _plainly_differ(x: Column, y: Column) -> Column:
    """The same of two plain bitmaps, written out: it is asked of every pair that meets."""
    return reduce(lambda a, b: a + b, [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(PARITY // 64)])


def _narrowed(x: Column, y: Column) -> Column:
    """``x`` as wide as ``y`` if that is half as wide: the parity of a bit modulo half the width is that of its two bits."""
    half = F.shiftright(F.size(x), 1)
    folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(x) > F.size(y), folded).otherwise(x)


def _arrays(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64()))


def _whole_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _arrays([shingles(t) for (t,) in rows_of(batch, "text")])], names=["sid", "grams"])


def _prefixes(shared: Shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = worker_cache(("similar", shared.key), lambda: shared.value)  # what an earlier operator kept goes
        for batch in sliced(batches, "text", SLICE_BYTES):
            found = [hashes(t or "", WORDS) for (t,) in rows_of(batch, "text")]
            sets = [np.unique(h).view(np.int64) for h in found]
            sids = pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
            prints = pa.array([packed(h) for h in found], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sids, prints, sizes, _arrays([parity(s) for s in sets]), _arrays([wide_parity(s) for s in sets]), _arrays([prefix(s, common, counts) for s in sets])], names=["doc_id", "text_hash", "sid", "fp", "n", "bits", "wide", "lead"])

    return run


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a similarity of 0.8 or more: of s shingles in sum, 9 x common >= 4 x s."""
    last: tuple = (None, None)
    for batch in sliced(batches, "b", SLICE_BYTES):
        kept = []
        for i, (one, a, b) in enumerate(rows_of(batch, "one", "a", "b")):
            if last[0] != one:
                last = one, shingles(a)
            x, y = last[1], shingles(b)
            if 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)) > 0:
                kept.append(i)
        found = batch.select(["one", "other"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.compute.min_element_wise(*found.columns), pa.compute.max_element_wise(*found.columns)], names=["lo", "hi"])


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in the sample, sorted, and how often."""
    slot = F.pmod(F.col("text_hash"), F.lit(SLOTS))
    upto = math.ceil(SLOTS * min(1.0, SAMPLE / max(1, rows.count())))
    some = rows.where(slot < upto).select(F.col("text_hash").alias("sid"), "text").dropDuplicates(["sid"]).limit(4 * SAMPLE)
    grams = some.mapInArrow(_whole_sets, "sid long, grams array<long>").select(F.explode("grams").alias("gram")).groupBy("gram").count()
    found = sorted((r[0], r[1]) for r in grams.where("count > 1").orderBy(F.desc("count"), "gram").limit(COMMON).collect())
    return np.array([g for g, _ in found], np.int64), np.array([c for _, c in found], np.int64)


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """lo, hi of the pairs (one, other) that are similar; a centre (one) of many pairs is repeated, so that these are spread."""
    a, b = (prints.select(F.col("sid").alias(name), F.struct("n", "bits").alias(f"own_{name}")) for name in ("one", "other"))
    pairs = write_shared(pairs.distinct(), "pairs")
    many = pairs.groupBy("one").agg((F.count("*") / PAIRS).cast("int").alias("parts")).where("parts > 0")
    parts = F.coalesce("parts", F.lit(0))
    spread = pairs.join(many, "one", "left").select("one", "other", F.pmod(F.xxhash64("other"), parts + 1).cast("int").alias("part"))
    repeated = lambda rows: rows.join(many, "one", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts))).drop("parts")
    n, m = F.col("own_one.n"), F.col("own_other.n")
    close = (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * _differ(F.col("own_one.bits"), F.col("own_other.bits")) <= n + m)
    alike = write_shared(spread.join(b, "other").join(repeated(a), ["one", "part"]).where(close).select("one", "other", "part", (n + m).alias("both")), "alike")
    # Large sets once more. If only one set of a pair has a wide bitmap, that is twice as wide as the plain one at most and decides no more.
    x, y = F.col("wide_one"), F.col("wide_other")
    c, d = (prints.where(F.size("wide") > 0).select(F.col("sid").alias(name), F.col("wide").alias(f"wide_{name}")) for name in ("one", "other"))
    large = alike.join(d, "other", "left").join(repeated(c), ["one", "part"], "left")
    alike = write_shared(large.where(x.isNull() | y.isNull() | (9 * _differ(_narrowed(x, y), _narrowed(y, x)) <= F.col("both"))).select("one", "other", "part"), "alike")
    # The texts of all sets that are compared, one of each.
    asked = alike.select(F.col("one").alias("sid")).union(alike.select("other")).distinct().join(prints.select("sid", "row"), "sid")
    asked = write_shared(asked.select("sid", F.col("row.doc_id").alias("own_id"), F.col("row.text_hash").alias("own_hash")), "asked")
    own = docs.join(few(asked), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    texts = write_shared(own.select("sid", "text"), "texts")
    if texts.count() > asked.count():  # rows that repeat whole
        texts = write_shared(texts.groupBy("sid").agg(F.min("text").alias("text")), "texts")
    left, right = texts.select(F.col("sid").alias("one"), F.col("text").alias("a")), texts.select(F.col("sid").alias("other"), F.col("text").alias("b"))
    return alike.join(right, "other").join(repeated(left), ["one", "part"]).select("one", "other", "a", "b").mapInArrow(_similar, "lo long, hi long")


def _pairs(met: DataFrame) -> DataFrame:
    """(one, other) of rows with sid, n, pos and c (the same of the one), if sizes and places allow the similarity."""
    n, m = F.col("n"), F.col("c.n")
    after = F.least(n - F.col("pos"), m - F.col("c.pos"))
    return met.where((5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * after >= 4 * (n + m)) & (F.col("sid") != F.col("c.sid"))).select(F.col("c.sid").alias("one"), F.col("sid").alias("other"))


def meetings(sets: DataFrame, heavy: DataFrame) -> DataFrame:
    """gram, sid, n, pos of the leading shingles that sets of fitting sizes share."""
    leads = sets.select("sid", F.posexplode("lead").alias("pos", "gram"), "n").select("gram", "sid", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    n = F.shiftright("at", 32)
    by_size = Window.partitionBy("gram").orderBy("at", "sid")
    near = leads.join(F.broadcast(heavy), "gram", "left_anti").withColumn("below", F.lag(n).over(by_size)).withColumn("above", F.lead(n).over(by_size))
    light = near.where((5 * F.col("below") >= 4 * n) | (4 * F.col("above") <= 5 * n)).select("gram", "sid", "at")
    met = light.union(leads.join(F.broadcast(heavy), "gram"))
    return met.select("gram", "sid", n.cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))


def joined(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, root once ``edges`` (lo, hi) are added: only the components they touch are looked at again."""
    if roots is None:
        return components(edges)
    ends = edges
    for end in ("lo", "hi"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end))
    between = ends.where("lo != hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
    moved = components(between)
    kept = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return write_shared(kept.union(moved.select("node", "root")), "roots")


def apart(met: DataFrame, prints: DataFrame) -> DataFrame:
    """(one, other) of all rows of met (gram, sid, n, pos, part) that share a shingle, are of different parts and may be similar."""
    # Every pair of different components has a member outside the component that most belong to.
    main = met.groupBy("gram", "part").count().groupBy("gram").agg(F.max_by("part", "count").alias("main"), (F.sum("count") > CROWD).alias("crowd"))
    bits = prints.select(F.col("sid").alias("own"), "bits")
    here = met.join(main, "gram").join(bits, (F.col("sid") == F.col("own")) & F.col("crowd"), "left").drop("own", "crowd")
    aside = here.where("part != main").select("gram", F.struct("sid", "n", "pos", "part", "bits").alias("c"))
    may = F.col("bits").isNull() | (9 * _plainly_differ(F.col("bits"), F.col("c.bits")) <= F.col("n") + F.col("c.n"))
    return _pairs(here.join(aside, "gram").where("part != c.part").where(may))


def roots_of_sets(docs: DataFrame, rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """node, root of all sets that are linked to a smaller one."""
    by_set = rows.groupBy("sid").agg(F.any_value("n").alias("n"), F.any_value("lead").alias("lead"))
    met = write_shared(meetings(by_set, heavy), "meeting")
    # Fingerprints two bits apart or less, by balls; sets of one fingerprint.
    prints = write_shared(rows.where("n > 0").groupBy("sid").agg(F.min("fp").alias("fp"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("wide").alias("wide")), "prints")
    first = prints.groupBy("fp").agg(F.min("sid").alias("sid"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("lo"), F.col("sid").alias("one")), "lo").join(first.select(F.col("fp").alias("hi"), F.col("sid").alias("other")), "hi").select("one", "other")
    equal = prints.select("fp", F.col("sid").alias("other")).join(first.select("fp", F.col("sid").alias("one")), "fp").where("one != other").select("one", "other")
    balls = write_shared(near.union(equal), "balls")
    edges = write_shared(_verified(balls, prints, docs), "similar")
    roots = joined(None, edges) if not edges.isEmpty() else None
    turn, last = 0, False
    while True:
        now = met.withColumn("part", F.col("sid"))
        if roots is not None:
            now = met.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("gram", "sid", "n", "pos", F.coalesce("root", "sid").alias("part"))
        # Of a shingle whose sets are of one component nothing is left to do.
        one = F.struct((F.lit(0) if turn else F.col("pos")).alias("before"), F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "n", "pos", "part")
        state = now.groupBy("gram").agg(F.min(one).alias("c"), F.min("part").alias("least"), F.max("part").alias("most")).where("least != most")
        open_ = now.join(state.select("gram", "c"), "gram")
        if last:
            pairs = apart(open_.drop("c"), prints)
        else:
            pairs = _pairs(open_.where("part != c.part"))
        new = write_shared(_verified(pairs, prints, docs), "similar")
        found = new.count()
        if found:
            roots = joined(roots, new)
        if last:
            return roots if roots is not None else edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        turn, last = turn + 1, found < FEW


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash of the rows that go: all of a component but that of the smallest doc_id (null last)."""
    texts = id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    common = common_shingles(texts)
    spark = docs.sparkSession
    heavy = spark.createDataFrame([(int(g),) for g, c in zip(*common) if c >= HEAVY], "gram long")
    kinds = "doc_id long, text_hash long, sid long, fp long, n int, bits array<long>, wide array<long>, lead array<long>"
    rows = write_shared(texts.select("doc_id", "text_hash", "text").mapInArrow(_prefixes(Shared(spark, common)), kinds), "shingles")
    roots = roots_of_sets(texts, rows, heavy)
    # The smallest row of each set first: a hot set is one row per task before the joins.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = rows.groupBy("sid").agg(F.min(row).alias("row"))
    classed = least.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "row", F.coalesce("root", "sid").alias("root"))
    best = classed.groupBy("root").agg(F.min("row").alias("best"), F.count("*").alias("sets"))
    # Rows of classes of one row alone are not looked at again.
    several = rows.groupBy("sid").agg(F.count("*").alias("rows"))
    hot = classed.join(several, "sid").join(best, "root").where("sets > 1 or rows > 1").select("sid", "best")
    own = rows.select("sid", "doc_id", "text_hash", row.alias("row")).join(hot, "sid")
    return own.where("row != best").select("doc_id", "text_hash").distinct()


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs``, one row of each component of near copies."""
    return drop_rows(docs, F.xxhash64(F.col("text").cast("string")), dropped(docs))
