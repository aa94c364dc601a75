"""The page log: a Python data source over an injectable fetch function, and the log's derived columns.

The engine never opens a connection itself. ``fetch(url, etag, last_modified)`` is given by the caller
and returns a dict of status, etag, last_modified, retry_after and body; tests give a dictionary's lookup.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from feltloom.functions.dates import retry_after_seconds
from feltloom.model import MAX_BODY_BYTES, PAGE_LOG
from feltloom.operators.gates import body_within_bounds, status_of


class _OnePage(InputPartition):
    def __init__(self, request: dict):
        self.request = request


def page_source(fetch: Callable[..., dict], name: str = "pages") -> type[DataSource]:
    """A data source that fetches the requests given as JSON in the option ``requests``, one task for each
    domain, so that requests to one domain never run beside each other."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            import json

            self.requests = json.loads(options["requests"])

        def partitions(self):
            from urllib.parse import urlsplit

            lanes: dict[str, list] = {}
            for r in self.requests:
                lanes.setdefault(urlsplit(r["url"]).netloc, []).append(r)
            return [_OnePage(lane) for lane in lanes.values()]

        def read(self, partition) -> Iterator[tuple]:
            import datetime

            for r in partition.request:
                got = fetch(r["url"], r.get("etag"), r.get("last_modified"))
                yield (r["source_id"], r["epoch"], r["url"], r.get("page_no", 1), got["status"], got.get("etag"), got.get("last_modified"), got.get("retry_after"), got.get("body"), datetime.datetime.fromisoformat(r["at"]))

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return PAGE_LOG

        def reader(self, schema):
            return Reader(self.options)

    return Pages


def fetch_pages(spark: SparkSession, fetch: Callable[..., dict], requests: list[dict]) -> DataFrame:
    """The page log of a poll's requests."""
    import json

    source = page_source(fetch)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("requests", json.dumps(requests)).load()


def classified(log: DataFrame) -> DataFrame:
    """The log with its status class and how long a throttled poll is to wait."""
    wait = F.when(status_of(F.col("status")) == "throttled", retry_after_seconds("retry_after", "fetched_at"))
    return log.withColumn("outcome", status_of(F.col("status"))).withColumn("wait_s", wait)


def bounded(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses within the size bound, rejects for the others)."""
    fits = F.col("body").isNull() | body_within_bounds(F.col("body"))
    rejects = log.where(~fits).select("source_id", "epoch", F.lit("").alias("guid"), F.lit("fetch").alias("stage"), F.lit(f"body over {MAX_BODY_BYTES} bytes").alias("reason"))
    return log.where(fits), rejects


def item_pages(items: DataFrame, log: DataFrame, url: str = "link") -> tuple[DataFrame, DataFrame]:
    """(items with the body of their own page, rejects of those without a readable one)."""
    read = log.where("status = 200").groupBy("url").agg(F.max_by("body", "epoch").alias("page_body"))
    joined = items.join(read, items[url] == read["url"], "left").drop("url")
    missing = joined.where("page_body is null")
    rejects = missing.select("source_id", "epoch", "guid", F.lit("identity").alias("stage"), F.lit("no readable page").alias("reason"))
    return joined.where("page_body is not null"), rejects
