"""Projection: a feed is what the latest successfully read page holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first in document order: a partial aggregate, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*").select(*rows.columns)


def drop_empty(rows: DataFrame, key: str = "guid") -> DataFrame:
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "")


def latest_epoch(observed: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows of each source's last epoch."""
    last = observed.groupBy(source).agg(F.max("epoch").alias("epoch"))
    return observed.join(last, [source, "epoch"], "left_semi")


def first_seen(observed: DataFrame, keys: list[str], at: str) -> DataFrame:
    """When each key was first observed; a later observation never moves it."""
    return observed.groupBy(*keys).agg(F.min(at).alias("first_seen"))


def dated(items: DataFrame, seen: DataFrame, keys: list[str], page_dates: DataFrame | None = None) -> DataFrame:
    """Own date, else the date of the item's own page, else first seen; ``pending``: the page is still unread."""
    joined = items.join(seen, keys, "left")
    if page_dates is not None:
        joined = joined.join(page_dates, keys, "left")
    page: Column = F.col("page_date") if page_dates is not None else F.lit(None).cast("timestamp")
    pending = F.col("pub_date").isNull() & page.isNull()
    return joined.withColumn("pending", pending).withColumn("pub_date", F.coalesce("pub_date", page, "first_seen")).drop("first_seen", "page_date")


def projection(observed: DataFrame) -> DataFrame:
    """Batch form: latest epoch, no empty keys, repeats dropped, undated items dated when first seen."""
    seen = first_seen(observed.where("pub_date is null"), ["source_id", "guid"], "observed_at")
    now = keep_first(drop_empty(latest_epoch(observed)), ["source_id", "guid"], "ord")
    return dated(now, seen, ["source_id", "guid"])


def carry_heading(rows: DataFrame, by: list[str], order: str, is_heading: Column, heading: Column) -> DataFrame:
    """Each row with the nearest heading before it."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("heading", F.last(F.when(is_heading, heading), ignorenulls=True).over(upto))


def number_sections(rows: DataFrame, by: list[str], order: str, is_heading: Column) -> DataFrame:
    """Sections counted from 1; 0 before the first heading."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.sum(is_heading.cast("int")).over(upto))


def fill_down(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Spanned cells: the last value that was given stands until the next."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(upto))


def pair_next(rows: DataFrame, by: list[str], order: str, is_artist: Column, is_title: Column, text: str) -> DataFrame:
    """Titles that follow an artist, the first of each artist's run alone."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("artist", F.last(F.when(is_artist, F.col(text)), ignorenulls=True).over(upto)).withColumn("run", F.sum(is_artist.cast("int")).over(upto))
    titles = runs.where(is_title & F.col("artist").isNotNull())
    first = F.row_number().over(Window.partitionBy(*by, "run").orderBy(order))
    return titles.withColumn("nth", first).where("nth = 1").drop("nth", "run")
