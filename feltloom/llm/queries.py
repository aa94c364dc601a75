"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feltloom.llm.byte_bpe import encode_decode
from feltloom.llm.common import documents
from feltloom.llm.exact_dedup import exact_dedup
from feltloom.llm.html_extract import main_text
from feltloom.llm.language import language_id
from feltloom.llm.packing import pack
from feltloom.llm.periodic import periodic_runs
from feltloom.llm.quality import quality
from feltloom.llm.simhash import near_duplicates
from feltloom.llm.store import store_digests
from feltloom.llm.token_counts import token_counts
from feltloom.llm.toxicity import toxicity
from feltloom.llm.upsert import client_upsert
from feltloom.llm.warc import archive_report


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), "byte_bpe_50k.json", 1)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), "byte_bpe_50k.json", 1024)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_digests(documents(spark, sf_dir), "word_bpe_49k.json", 2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), "byte_bpe_50k.tiktoken")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client_upsert(spark.read.parquet(f"{sf_dir}/clients.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), periodic=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_token_store": op8_token_store,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_warc": op11_warc,
    "op12_keyed_upsert": op12_keyed_upsert,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t
        WINDOW best AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id ASC NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
}
