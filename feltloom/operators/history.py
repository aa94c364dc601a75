"""Catalog history: live items and the newest K ever seen, and what of it a feed shows.

Batch form over all that was observed. The merge takes an item's last row whole, its date too; the incremental form
prunes by the dates known at the time, so both agree as long as an item's date does not move. Each step is one shuffle by source: the window of the rank
is the only one that needs a source's rows together, and nothing wider than the item travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltloom.model import MIN_LIVE_REPLIES, STORED_LIMIT, VISIBLE_LIMIT

KEYS = ["source_id", "guid"]


def newest_first(source: str = "source_id") -> Window:
    return Window.partitionBy(source).orderBy(F.col("pub_date").desc(), F.col("guid").asc())


def merge_observed(observed: DataFrame) -> DataFrame:
    """The last observation of each item: a partial aggregate, so a source polled for years costs no sort."""
    rest = [c for c in observed.columns if c not in (*KEYS, "epoch")]
    last = observed.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "epoch").alias("row"))
    return last.select(*KEYS, "row.*")


def live_items(observed: DataFrame) -> DataFrame:
    """Items of each source's last epoch that has any: one of nothing, or of empty ids alone, never clears the live set."""
    named = observed.where("guid <> ''")
    last = named.groupBy("source_id").agg(F.max("epoch").alias("epoch"))
    return named.join(last, ["source_id", "epoch"], "left_semi").select(*KEYS).distinct()


def prune(items: DataFrame, live: Column, stored: int = STORED_LIMIT) -> DataFrame:
    """Survivors: live items, and the newest ``stored`` of all items of the source (live ones count).

    The rank alone is filtered first, which Spark limits per task before the shuffle: a source with a third
    of all rows sends ``stored`` rows of each task. Live items beyond it are then found by key.
    """
    limit = stored if stored > 0 else STORED_LIMIT
    flagged = items.withColumn("live", live)
    newest = flagged.withColumn("rank", F.row_number().over(newest_first())).where(F.col("rank") <= limit).drop("rank")
    older = flagged.where("live").join(newest.select(*KEYS), KEYS, "left_anti")
    return newest.unionByName(older)


def visible(items: DataFrame, min_live: int = MIN_LIVE_REPLIES, limit: int = VISIBLE_LIMIT) -> DataFrame:
    """A feed's rows: immature live items are hidden, of the rest the newest ``limit``, with their place."""
    shown = items.where(~F.col("live") | (F.col("replies") >= min_live))
    return shown.withColumn("place", F.row_number().over(newest_first())).where(F.col("place") <= (limit if limit > 0 else VISIBLE_LIMIT))


def with_live(items: DataFrame, live: DataFrame) -> DataFrame:
    """Items with a flag from the live set; Spark broadcasts the set only if it is small."""
    return items.join(live.select(*KEYS, F.lit(True).alias("is_live")), KEYS, "left").withColumn("live", F.coalesce("is_live", F.lit(False))).drop("is_live")


def history(observed: DataFrame, stored: int = STORED_LIMIT) -> DataFrame:
    """Batch form of all epochs: merge, flag live, prune."""
    return prune(with_live(merge_observed(observed), live_items(observed)), F.col("live"), stored)
