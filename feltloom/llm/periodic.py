"""Periodic runs of words: every lag of a text compared with the text itself.

A run is a stretch of consecutive words whose smallest period q gives it at least ``LEAST_EXPONENT`` periods and
``LEAST_WORDS`` words, and that no neighbouring word extends keeping q. For each lag q up to n / LEAST_EXPONENT the
array of word ids is compared with itself shifted by q; a true stretch of s words is s + q words of period q,
as long as they can be. Of lags that give the same stretch of words the smallest is its period: it divides the
others (two periods that a stretch of twice their length has are multiples of one that it has), so a stretch counts if no q
divided by a prime is a period of it as well.

The work of a text grows with the square of its length. Texts of up to ``WORK`` comparisons are scanned where they are read,
many at a time: their ids stand one after another, longest first, with an id between them that nothing else has, so a lag
is one vector operation over all texts that are long enough for it (two texts agree across the border on fewer than q
words, too few for a run). Longer texts are dealt out as (text, range of lags), each at most ``WORK`` comparisons, and their
runs meet again by text. Nothing is cut: a text is its own bound on memory, a few bytes a word.

Defined results: a null, empty or blank text has no words and no runs; fewer than ``LEAST_WORDS`` words give none. Rows
that repeat stay, each with its result; a null doc_id is a doc_id of its own (and is never made periodic by the
contract's rule). Ties of the greatest exponent go to the smallest start, then period. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.llm.common import id_text, rows_of, sliced

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Comparisons of a (text, lags) unit; a text of about 46,000 words is one unit.
WORK = 1 << 29
#: Bytes of text handled at a time; texts of more words than ALONE are scanned alone.
SLICE_BYTES, ALONE = 4 << 20, 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = "key string, start long, length long, period long"
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]


def made_periodic(words: list[str], doc_id: int | None) -> list[str]:
    """The contract's rule: one text in ten becomes periodic from some word on."""
    h, n = crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * -(-(n - a) // p))[: n - a]


def numbering() -> dict[str, int]:
    """Gives each new word the next number."""
    return defaultdict(count().__next__)


def word_ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _primes_of(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def _stretches(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least ``least`` words that equal the word q further on."""
    same = ids[:-q] == ids[q:]
    if np.count_nonzero(same) < least:
        return []
    at = np.flatnonzero(same)
    if not (at[least - 1 :] - at[: len(at) - least + 1] == least - 1).any():
        return []
    breaks = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + 1
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def scan(ids: np.ndarray, lags: range) -> list[Run]:
    """The runs (start, length, period) of one array, or of several with ids between them that stand nowhere else."""
    found = []
    for q in lags:
        if LEAST_EXPONENT * q > len(ids):
            break
        for start, end in _stretches(ids, q, max(LEAST_WORDS, LEAST_EXPONENT * q) - q):
            end += q
            if not any((ids[start : end - q // p] == ids[start + q // p : end]).all() for p in _primes_of(q)):
                found.append((start, end - start, q))
    return found


def runs_of(texts: list[list[str]]) -> list[list[Run]]:
    """Each text's runs, by start, then period; short texts together."""
    known = numbering()
    ids = [word_ids(words, known) for words in texts]
    out: list[list[Run]] = [[] for _ in texts]
    together = sorted((i for i in range(len(texts)) if LEAST_WORDS <= len(ids[i]) <= ALONE), key=lambda i: -len(ids[i]))
    sizes = np.array([len(ids[i]) for i in together], np.int64)
    if len(together):
        borders = np.arange(-1, -1 - len(together), -1, dtype=np.int32)  # ids that no word has
        joined = np.concatenate([x for i, border in zip(together, borders) for x in (ids[i], [border])]).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        for q in range(1, int(sizes[0]) // LEAST_EXPONENT + 1):
            enough = int(np.searchsorted(-sizes, -LEAST_EXPONENT * q, side="right"))
            for start, length, period in scan(joined[: starts[enough]], range(q, q + 1)):
                k = int(np.searchsorted(starts, start, side="right")) - 1
                out[together[k]].append((start - int(starts[k]), length, period))
    for i, array in enumerate(ids):
        if len(array) > ALONE:
            out[i] = scan(array, range(1, len(array) // LEAST_EXPONENT + 1))
        out[i].sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[str], runs: list[Run]) -> list[str]:
    """The words that no run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def summary(words: list[str], runs: list[Run]) -> tuple:
    """n_runs; start, length, period, exponent_milli of the greatest; digests of the runs and of the kept words."""
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    rest = hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, listed, rest
    best = runs[0]
    for run in runs[1:]:  # exact: a longer product is a greater exponent
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return len(runs), *best, 1000 * best[1] // best[2], listed, rest


def _words(doc_id: int | None, text: str | None, periodic: bool) -> list[str]:
    words = _WORD.findall(text or "")
    return made_periodic(words, doc_id) if periodic else words


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])


def _scan_whole(periodic: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            docs = [(doc_id, _words(doc_id, text, periodic)) for doc_id, text in rows_of(batch, "doc_id", "text")]
            found = runs_of([words for _, words in docs])
            yield _results([(doc_id, *summary(words, runs)) for (doc_id, words), runs in zip(docs, found)])

    return run


def _scan_lags(periodic: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            rows = []
            for key, doc_id, text, low, high in rows_of(batch, "key", "doc_id", "text", "low", "high"):
                ids = word_ids(_words(doc_id, text, periodic), numbering())
                rows += [(key, *run) for run in scan(ids, range(low, high))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), *[pa.int64()] * 3))], names=["key", "start", "length", "period"])

    return run


def _gather(periodic: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            rows = []
            for doc_id, text, runs in rows_of(batch, "doc_id", "text", "runs"):
                listed = sorted(((r["start"], r["length"], r["period"]) for r in runs or ()), key=lambda r: (r[0], r[2]))
                rows.append((doc_id, *summary(_words(doc_id, text, periodic), listed)))
            yield _results(rows)

    return run


def periodic_runs(docs: DataFrame, periodic: bool = False, work: int = WORK) -> DataFrame:
    """Per row: doc_id, n_runs, the greatest run, and digests of all runs and of the words that are kept.

    ``periodic`` first makes one text in ten periodic, as the contract of the query says.
    """
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).cast("long")  # at most one more than there are at each end
    rows = id_text(docs).withColumn("words", words)
    lags = F.floor(F.col("words") / LEAST_EXPONENT)
    units = F.ceil(F.col("words") * lags / F.lit(work))
    rows = rows.withColumn("lags", lags).withColumn("units", F.greatest(F.least(units, lags), F.lit(1)))
    short = rows.where("units = 1").select("doc_id", "text").mapInArrow(_scan_whole(periodic), RESULT)
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.col("text")), 256)
    long = rows.where("units > 1").withColumn("key", key)
    low = lambda unit: F.floor(F.col("lags") * unit / F.col("units")) + 1
    dealt = long.dropDuplicates(["key"]).withColumn("unit", F.explode(F.sequence(F.lit(0), (F.col("units") - 1).cast("int"))))
    dealt = dealt.select("key", "doc_id", "text", low(F.col("unit")).alias("low"), (low(F.col("unit") + 1)).alias("high"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = dealt.repartition(partitions, "key", "low").mapInArrow(_scan_lags(periodic), _RUNS)
    gathered = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    whole = long.join(gathered, "key", "left").select("doc_id", "text", "runs").mapInArrow(_gather(periodic), RESULT)
    return short.union(whole)
