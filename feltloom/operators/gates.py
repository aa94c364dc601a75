"""Gates: an epoch counts only if all of it was read. A failed epoch changes nothing downstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltloom.model import MAX_BODY_BYTES, MAX_PAGES

MODES = ("projection", "history", "change", "announcement")
#: How an announcement source decides; without one: once, after a silent first poll.
POLICIES = (None, "numbers", "read_once", "window", "names")


def validate_sources(rows: list[dict]) -> None:
    """Driver-side: ids present and unique, an absolute web URL, a known mode, a history policy just for history."""
    seen = set()
    for row in rows:
        name = row.get("id") or ""
        if not name or name in seen:
            raise ValueError(f"source id {name!r} is empty or repeated")
        seen.add(name)
        if not str(row.get("url", "")).lower().startswith(("http://", "https://")):
            raise ValueError(f"source {name} has no web URL")
        if row.get("mode") not in MODES:
            raise ValueError(f"source {name} has no known mode")
        if (row.get("history") is not None) != (row.get("mode") == "history"):
            raise ValueError(f"source {name}: a history policy belongs to history mode")
        if row.get("policy") not in POLICIES or row.get("policy") and row["mode"] != "announcement":
            raise ValueError(f"source {name} has no such policy")
        if not (row.get("meta") or {}).get("title"):
            raise ValueError(f"source {name} has no title")


def status_of(code: Column) -> Column:
    return F.when(code == 200, "modified").when(code == 304, "unchanged").when(code.isin(429, 503), "throttled").otherwise("error")


def body_within_bounds(body: Column) -> Column:
    return F.octet_length(body) <= MAX_BODY_BYTES


def pages_complete(pages: DataFrame) -> DataFrame:
    """source_id, epoch, complete from page headers (page, total_pages, total_items) and the ids of a page's items.

    All pages from the first on, their headers alike, as many items as declared, and no id empty or there twice in the epoch,
    on whatever pages.
    """
    keys = ["source_id", "epoch"]
    named = pages.select(*keys, F.explode("ids").alias("id")).groupBy(*keys).agg(F.countDistinct("id").alias("n_ids"), F.count_if(F.coalesce(F.col("id"), F.lit("")) == "").alias("n_empty"))
    one = pages.groupBy("source_id", "epoch").agg(
        F.count("*").alias("n_pages"), F.countDistinct("page").alias("n_distinct"), F.min("page").alias("low"), F.max("page").alias("high"), F.min("total_pages").alias("least_total"),
        F.max("total_pages").alias("most_total"), F.min("total_items").alias("least_items"), F.max("total_items").alias("most_items"), F.sum(F.size(F.coalesce("ids", F.array().cast("array<string>")))).alias("n_items"),
    ).join(named, keys, "left").na.fill(0, ["n_ids", "n_empty"])
    complete = (
        (F.col("low") == 1) & (F.col("least_total") == F.col("most_total")) & (F.col("least_items") == F.col("most_items")) & F.col("most_total").between(0, MAX_PAGES)
        & (F.col("n_pages") == F.greatest(F.col("most_total"), F.lit(1))) & (F.col("n_distinct") == F.col("n_pages")) & (F.col("high") == F.col("n_pages")) & (F.col("n_items") == F.col("most_items")) & (F.col("n_ids") == F.col("n_items")) & (F.col("n_empty") == 0)
    )
    return one.select("source_id", "epoch", "n_pages", "n_items", F.coalesce(complete, F.lit(False)).alias("complete"))


def counted(items: DataFrame, declared: str) -> DataFrame:
    """source_id, epoch, ok: as many items as declared, ids present and not repeated, at least one unless none is declared."""
    one = items.groupBy("source_id", "epoch").agg(F.count("guid").alias("n"), F.countDistinct("guid").alias("ids"), F.max(declared).alias("declared"), F.sum(F.when(F.col("guid") == "", 1).otherwise(0)).alias("empty"))
    return one.select("source_id", "epoch", ((F.col("n") == F.col("declared")) & (F.col("n") == F.col("ids")) & (F.col("empty") == 0)).alias("ok"))


def successful_epochs(log: DataFrame, observed: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Epochs of which every page was read and that have an item; rejected ones (source_id, epoch) are left out."""
    read = log.groupBy("source_id", "epoch").agg(F.min((status_of(F.col("status")) == "modified") & body_within_bounds(F.col("body"))).alias("ok")).where("ok").drop("ok")
    found = read.join(observed.select("source_id", "epoch").distinct(), ["source_id", "epoch"], "left_semi")
    return found if rejected is None else found.join(rejected, ["source_id", "epoch"], "left_anti")


def unique_or_fail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; reading them fails if a key is repeated."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    checked = counts.withColumn("ok", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws(",", *keys)))).otherwise(F.lit(True)))
    return rows.join(checked.where("ok").select(*keys), keys, "left_semi")


def validators(log: DataFrame) -> DataFrame:
    """etag and last_modified in force after each epoch: replaced by a 200, kept by a 304 that sends none."""
    from pyspark.sql import Window

    upto = Window.partitionBy("source_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A 200 without the header clears it: the value is wrapped, so that last() takes it, null or not.
    kept = lambda name: F.last(F.when(F.col("status") == 200, F.struct(F.col(name))).when((F.col("status") == 304) & F.col(name).isNotNull(), F.struct(F.col(name))), ignorenulls=True).over(upto)[name]
    return log.select("source_id", "epoch", kept("etag").alias("etag"), kept("last_modified").alias("last_modified"))
