"""Announcements: each identity is published once, against what was published before.

Closed forms over all epochs where the decision about an item needs nothing but its own appearances.
Items whose page could not be read are no candidates (they are quarantined, not booked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltloom.model import ENRICH_BATCH, HOLD_DAYS

NOT_QUARANTINABLE = ["throttled", "cancelled"]


def appearances(observed: DataFrame, key: str = "guid") -> DataFrame:
    """The first epoch of each identity, and the source's own first epoch."""
    first = observed.groupBy("source_id", key).agg(F.min("epoch").alias("first_epoch"))
    return first.join(observed.groupBy("source_id").agg(F.min("epoch").alias("baseline")), "source_id")


def announce_numbers(observed: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """source_id, number, epoch: at first the newest number alone; later every number above that one, when it first appears.

    ``initial`` (source_id, initial): what sources that were polled before began with; they have no first poll any more.
    """
    first = observed.groupBy("source_id").agg(F.min("epoch").alias("baseline"))
    if initial is not None:
        first = first.join(initial, "source_id", "left_anti")
    started = observed.join(first, "source_id").where("epoch = baseline").groupBy("source_id", "baseline").agg(F.max("number").alias("initial"))
    if initial is not None:
        started = started.unionByName(initial.select("source_id", "initial"), allowMissingColumns=True)
    seen = observed.groupBy("source_id", "number").agg(F.min("epoch").alias("epoch"))
    return seen.join(started, "source_id").where("number > initial or number = initial and epoch = baseline").select("source_id", "number", "epoch")


def first_numbers(observed: DataFrame) -> DataFrame:
    """source_id, initial: the newest number of each source's first epoch."""
    newest = observed.groupBy("source_id", "epoch").agg(F.max("number").alias("number"))
    return newest.groupBy("source_id").agg(F.min_by("number", "epoch").alias("initial"))


def first_ready(candidates: DataFrame, ready: str, keys: tuple[str, ...] = ("source_id", "guid")) -> tuple[DataFrame, DataFrame]:
    """(rows at the first epoch at which a candidate is ready, its rows at the epochs before, or all if it never is).

    An item that can't be decided when it appears is decided at the first poll that can, once.
    """
    when = candidates.where(ready).groupBy(*keys).agg(F.min("epoch").alias("decided"))
    joined = candidates.join(when, list(keys), "left")
    return joined.where("epoch = decided").drop("decided"), joined.where("decided is null or epoch < decided").drop("decided")


def announce_once(observed: DataFrame, publishable: Column | None = None) -> DataFrame:
    """Identities that first appear after the silent baseline; what isn't publishable then is remembered silently."""
    first = appearances(observed)
    new = observed.join(first, ["source_id", "guid"]).where("epoch = first_epoch and first_epoch > baseline")
    return new.where(publishable) if publishable is not None else new


def announce_in_window(observed: DataFrame, today: Column, first_day: Column, days: int = HOLD_DAYS) -> DataFrame:
    """source_id, guid, epoch: the first epoch at which an item on the page is within the window (no lower bound)."""
    return observed.where(first_day <= F.date_add(today, days)).groupBy("source_id", "guid").agg(F.min("epoch").alias("epoch"))


def unannounced(candidates: DataFrame, announced: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(announced, keys, "left_anti")


def unannounced_names(candidates: DataFrame, announced: DataFrame) -> DataFrame:
    """Candidates none of whose names (``names array<string>``) was announced before by the source."""
    met = candidates.select("source_id", "guid", F.explode("names").alias("name")).join(announced, ["source_id", "name"], "left_semi").select("source_id", "guid").distinct()
    return candidates.join(met, ["source_id", "guid"], "left_anti")


def quarantine(items: DataFrame, unreadable: Column, stage: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(items to go on with, rejects with stage and reason)."""
    bad = F.coalesce(unreadable, F.lit(False))
    return items.where(~bad), items.where(bad).withColumn("stage", F.lit(stage)).withColumn("reason", reason)


def quarantinable(reason: Column) -> Column:
    """Throttling and cancellation concern the poll, not the item."""
    return ~reason.isin(NOT_QUARANTINABLE)


def enrich(items: DataFrame, facts: DataFrame, key: str, first: str) -> DataFrame:
    """Items with the first matching row of facts (least ``first``)."""
    rest = [c for c in facts.columns if c != key]
    best = facts.groupBy(key).agg(F.min_by(F.struct(*rest), first).alias("fact"))
    return items.join(best, key, "left").select(*[items[c] for c in items.columns], "fact.*")


def batches(items: DataFrame, by: list[str], order: str, size: int = ENRICH_BATCH) -> DataFrame:
    """Items with the number of their lookup batch."""
    return items.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size))


def forget_departed(held: Column, on_page: Column) -> Column:
    """Of a map of held items those that are still on the page."""
    return F.map_filter(held, lambda k, v: F.array_contains(on_page, k))


def every_batch_read(requested: DataFrame, read: DataFrame) -> DataFrame:
    """source_id, epoch, ok: batch lookups are all or nothing; one that is missing, or gave another number of rows, fails the epoch."""
    joined = requested.join(read.withColumnRenamed("n", "n_read"), ["source_id", "epoch", "batch"], "left")
    return joined.groupBy("source_id", "epoch").agg(F.min(F.coalesce(F.col("n_read") == F.col("n"), F.lit(False))).alias("ok"))


def same_identity(before: Column, after: Column) -> Column:
    """``after``; reading it fails if enrichment changed an identity."""
    return F.when(before.eqNullSafe(after), after).otherwise(F.raise_error(F.concat(F.lit("enrichment changes the identity "), before)))


def pending_queue(stored: DataFrame, wanted: DataFrame, polled: DataFrame) -> DataFrame:
    """The pending pages after some polls: those that the last poll of a source lacked, with the polls that lacked them in a row.

    Sources that were not polled keep theirs; what a later poll had, or what left its page, is no longer asked for.
    """
    last = polled.groupBy("source_id").agg(F.max("epoch").alias("epoch"))
    tries = wanted.groupBy("source_id", "guid").agg(F.countDistinct("epoch").cast("int").alias("tries"), F.max_by(F.struct("purpose", "url"), "epoch").alias("page"), F.max("epoch").alias("epoch"))
    still = tries.join(last, ["source_id", "epoch"], "left_semi").join(stored.select("source_id", "guid", F.col("attempts").alias("before")), ["source_id", "guid"], "left")
    now = still.select("source_id", "guid", "page.purpose", "page.url", (F.coalesce("before", F.lit(0)) + F.col("tries")).alias("attempts"), "epoch")
    return stored.join(last.select("source_id"), "source_id", "left_anti").unionByName(now)
