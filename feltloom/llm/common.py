"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only where the session names none (a single machine, tests) a temporary
    folder is made and set; on a cluster that is an error, as other machines would not see it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        root = "file://" + tempfile.mkdtemp(prefix="feltloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


_scratch: list[Callable[[], object]] = []


@atexit.register
def _clean_up() -> None:
    """When the driver ends, what its queries wrote for themselves goes."""
    for remove in _scratch:
        with contextlib.suppress(Exception):  # the session may have ended before
            remove()


def kept_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what a query writes and leaves there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _scratch.append(lambda: target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new table name in the shared warehouse, dropped when the driver ends."""
    table = f"feltloom_{name}_{uuid.uuid4().hex}"
    _scratch.append(lambda: spark.sql(f"DROP TABLE IF EXISTS {table}"))
    return table


def write_shared(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a durable cut of the lineage.

    Every executor sees the files, so a lost executor costs no recomputation.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or shipped; a path that isn't there is passed over.
    """
    top, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (top, *paths) if p)


#: Bytes of rows that are sent to a Python worker at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers ``BATCH_BYTES`` at a time, unless the session has its own setting.

    Spark's 64 MB of texts are held outside the heap, twice while their buffer grows, for each core, and once more by its worker.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: extra columns, whatever their names, never reach an operator."""
    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keep_rows(docs: DataFrame, text_hash: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_hash) is in ``kept`` (one row each), one if they repeat.

    The rows travel as one struct, so no column of theirs can clash. A doc_id's rows meet in one task;
    a hot text doesn't, as the id is part of the key.
    """
    keys = ("key_id", "key_none", "key_hash")
    doc_id = F.col("doc_id").cast("long")
    key = lambda h: [F.coalesce(doc_id, F.lit(0)).alias(keys[0]), doc_id.isNull().alias(keys[1]), h.alias(keys[2])]
    rows = docs.select(*key(text_hash), F.struct("*").alias("row"))
    found = rows.join(kept.select(*key(F.col("text_hash"))), list(keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))
    return found.withColumn("first", first).where("first = 1").select("row.*")


#: Rows of a few numbers each up to which a table is broadcast.
FEW_ROWS = 2_000_000


def few(keys: DataFrame) -> DataFrame:
    """``keys`` (a few numbers a row, written before), marked for a broadcast if they are counted and few."""
    return F.broadcast(keys) if keys.count() <= FEW_ROWS else keys


def drop_rows(docs: DataFrame, text_hash: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_hash) is in ``gone``, and one of rows that repeat.

    Few keys are broadcast and the texts stay where they are; many are joined. Only rows that repeat are shuffled.
    """
    key = ["key_id", "key_none", "key_hash"]
    doc_id = F.col("doc_id").cast("long")
    keyed = lambda h: [F.coalesce(doc_id, F.lit(0)).alias(key[0]), doc_id.isNull().alias(key[1]), h.alias(key[2])]
    rows = docs.select(*keyed(text_hash), F.struct("*").alias("row"))
    away = write_shared(gone.select(*keyed(F.col("text_hash"))), "gone")
    left = rows.join(few(away), key, "left_anti")
    again = write_shared(left.groupBy(*key).count().where("count > 1").drop("count"), "again")
    if again.isEmpty():
        return left.select("row.*")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(key[0]))
    once = left.join(few(again), key, "left_semi").withColumn("first", first).where("first = 1")
    return left.join(few(again), key, "left_anti").select("row").union(once.select("row")).select("row.*")


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterable[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [n or 0 for n in pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


_kept: dict = {}


def worker_cache(key: tuple, build: Callable):
    """What a Python worker keeps from one task to the next: one thing, that of the operator it last served.

    Workers outlive queries and serve several operators, so each new key drops what was kept for the last.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


class Shared:
    """A broadcast value with a key that no other broadcast of the application has."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.key = self.broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, looked up where the code runs."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
