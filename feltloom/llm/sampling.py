"""Bounded samples of labelled rows for the models that are fitted here."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Hash values that a sample's bound is cut from.
SLOTS = 1 << 40


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_ids(rows: DataFrame, most: int, spare: int = 4) -> DataFrame:
    """At most ``most`` distinct doc_ids, those of the smallest hashes: a sample that doesn't depend on partitions.

    The rows are counted first, so that only ids of hashes low enough for about ``spare * most`` rows are
    sorted at all: what meets in one task is as small for a large table as for a small one.
    """
    ids = rows.where("doc_id is not null").select("doc_id")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    upto = math.ceil(SLOTS * min(1.0, spare * most / max(1, ids.count())))
    return ids.where(slot < upto).distinct().orderBy(slot, F.xxhash64("doc_id"), "doc_id").limit(most)


def fitted_in_task(sample: DataFrame, train: Callable[[list[tuple]], object], empty: Callable[[], object]):
    """What ``train`` makes of the rows of a bounded sample, run in one task so that the driver holds the model alone.

    Rows come in no given order: ``train`` sorts them. An empty sample gives ``empty()``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else empty()
