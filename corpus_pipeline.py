"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before kept, calls one of the operators, and returns the columns
of documents, but for the last, which returns the pieces of the packed sequences. Nulls, blanks, very
long texts, ties, repeated rows, empty tables and extra columns have the results that the operators
state: language ID rejects what has no letters; a null text is never kept by it; of equal and of nearly
equal texts one row stays, the one with the smallest doc_id (null last; of exact copies first the
longest); an empty table stays empty to the end. Texts go to the Python workers a few MB at a time: the stages set
that for the session, unless it has its own setting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feltloom.llm.common import documents, small_batches, write_shared
from feltloom.llm.exact_dedup import drop_exact_duplicates
from feltloom.llm.language import drop_undetermined
from feltloom.llm.packing import pack
from feltloom.llm.similar import drop_similar
from feltloom.llm.toxicity import drop_toxic


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_undetermined(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_similar(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(docs, "byte_bpe_50k.json", 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Two stages score with models that are trained here, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
