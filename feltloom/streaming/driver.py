"""Incremental drivers: observations arrive as micro-batches, one or more epochs of each source at a time.

Each micro-batch is committed as one manifest of the store, numbered by its batch id, so that a batch that
is run again after a failure is passed over. The steps are the batch operators, applied to what is stored
and what is new; replaying all batches gives what the batch form gives over all epochs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feltloom.model import FEED_ITEMS, OBSERVATIONS, STORED_LIMIT
from feltloom.operators import announce, changes, history, projection, sinks

ITEM = [c.split()[0] for c in FEED_ITEMS.split(", ")]


def project(store: sinks.Store, observed: DataFrame, batch: int | None = None) -> bool:
    """Snapshot replace of the polled sources; undated items keep the time they were first seen."""
    undated = observed.where("pub_date is null and guid <> ''").groupBy("source_id", "guid").agg(F.min("observed_at").alias("ts"))
    seen = sinks.keep_earliest(store.table("first_seen"), undated, ["source_id", "guid"], "ts")
    now = projection.keep_first(projection.drop_empty(projection.latest_epoch(observed)), ["source_id", "guid"], "ord")
    dated = projection.dated(now, seen.withColumnRenamed("ts", "first_seen"), ["source_id", "guid"], store.table("item_dates").withColumnRenamed("ts", "page_date"))
    items = sinks.replace_source(store.table("feed_items"), dated.select(*ITEM), observed.select("source_id"))
    return store.commit({"feed_items": items, "first_seen": seen}, batch)


def keep_history(store: sinks.Store, observed: DataFrame, batch: int | None = None, stored: int = STORED_LIMIT, rebuilt: DataFrame | None = None) -> bool:
    """Upsert, replace the live set of sources that showed anything, prune these. An empty observation changes nothing.

    ``rebuilt``: stored rows derived anew, which replace what they were before the new ones come.
    """
    shown = observed.where("guid <> ''")
    polled = shown.select("source_id").distinct()
    before = store.table("feed_items")
    own = before.join(polled, "source_id", "left_semi")
    if rebuilt is not None:
        own = sinks.upsert(own, rebuilt.join(polled, "source_id", "left_semi").select(*ITEM), ["source_id", "guid"])
    items = sinks.upsert(own, history.merge_observed(shown).select(*ITEM), ["source_id", "guid"])
    live = sinks.replace_source(store.table("live"), history.live_items(shown), polled)
    pruned = history.prune(history.with_live(items, live), F.col("live"), stored)
    return store.commit({"feed_items": before.join(polled, "source_id", "left_anti").unionByName(pruned.select(*ITEM)), "live": live}, batch)


def numbered_changes(store: sinks.Store, observed: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes of these epochs with the revisions they will have, in the order of publication; the epochs with version and instant).

    Columns: source_id, epoch, guid (the entity), revision, title, link, description, metadata, at, past.
    """
    state = store.table("change_state")
    epochs = observed.groupBy("source_id", "epoch").agg(F.min("observed_at").alias("at")).join(versions.select("source_id", "version"), "source_id")
    before = epochs.groupBy("source_id").agg((F.min("epoch") - 1).alias("epoch"))
    entity = ["source_id", "epoch", "guid", F.struct("title", "link", "metadata").alias("value")]
    rows = store.table("baseline").join(before, "source_id").select(*entity).unionByName(observed.select(*entity))
    compared = state.join(before, "source_id").select("source_id", "epoch", "version").unionByName(epochs.select("source_id", "epoch", "version"))
    raw = store.cut(changes.change_events(rows, compared, "value"))
    events = changes.revisions(store.cut(changes.shown(raw)))
    past = state.select("source_id", F.col("revision").alias("past"))
    numbered = events.join(past, "source_id", "left").join(epochs.select("source_id", "epoch", "at"), ["source_id", "epoch"])
    return numbered.withColumn("revision", F.coalesce("past", F.lit(0)) + F.col("revision")), epochs


def watch_changes(store: sinks.Store, observed: DataFrame, versions: DataFrame, batch: int | None = None, titled: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Any number of epochs of each source, compared as in the batch form; the stored baseline is the epoch before them.

    The first observation, and the first of another version (``versions``: source_id, version), is a silent baseline.
    ``titled`` gives changes their titles and covers from lookups, before they are published.
    """
    state = store.table("change_state")
    past = state.select("source_id", F.col("revision").alias("past"))
    numbered, epochs = numbered_changes(store, observed, versions)
    shown = titled(numbered) if titled else numbered
    published = shown.select("source_id", F.concat_ws(":", "source_id", F.col("revision").cast("string"), "guid").alias("guid"), "title", "link", "description", "metadata", F.col("at").alias("pub_date"), F.lit(0).alias("replies"))
    last = epochs.groupBy("source_id").agg(F.max_by("version", "epoch").alias("version")).join(past, "source_id", "left")
    moved = numbered.groupBy("source_id").agg(F.max("revision").alias("revision"))
    new_state = last.join(moved, "source_id", "left").select("source_id", "version", F.coalesce("revision", "past", F.lit(0)).cast("bigint").alias("revision"))
    return store.commit(
        {
            "feed_items": sinks.insert_ignore(store.table("feed_items"), published, ["source_id", "guid"]),
            "baseline": sinks.replace_source(store.table("baseline"), projection.latest_epoch(observed).select("source_id", "guid", "title", "link", "metadata", "ord"), observed.select("source_id")),
            "change_state": sinks.upsert(state, new_state, ["source_id"]),
        },
        batch,
    )


def announce_new(store: sinks.Store, observed: DataFrame, batch: int | None = None, publishable: str = "true") -> bool:
    """Publish identities that were not booked before; a source's first poll is a silent baseline. All that was seen is booked.

    An epoch with an item that has no identity is no poll: it books and publishes nothing.
    """
    booked = store.table("announced")
    nameless = observed.where("coalesce(guid, '') = ''").select("source_id", "epoch").distinct()
    whole = observed.join(nameless, ["source_id", "epoch"], "left_anti").withColumn("place", F.struct("epoch", "ord"))
    silent = whole.groupBy("source_id").agg(F.min("epoch").alias("silent")).join(booked.select("source_id").distinct(), "source_id", "left_anti")
    first = projection.keep_first(whole, ["source_id", "guid"], "place")
    new = announce.unannounced(first, booked.select("source_id", "guid"), ["source_id", "guid"])
    published = new.join(silent, "source_id", "left").where("silent is null or epoch > silent").where(publishable).withColumn("pub_date", F.coalesce("pub_date", "observed_at"))
    book = new.select("source_id", "guid", F.lit(None).cast("string").alias("name"))
    return store.commit({"feed_items": sinks.insert_ignore(store.table("feed_items"), published.select(*ITEM), ["source_id", "guid"]), "announced": sinks.insert_ignore(booked, book, ["source_id", "guid"])}, batch)


def _change_step(store: sinks.Store, observed: DataFrame, batch: int | None = None, **options) -> bool:
    return watch_changes(store, observed, options["versions"], batch, options.get("titled"))


STEPS = {"projection": project, "history": keep_history, "change": _change_step, "announcement": announce_new}


def run_stream(spark: SparkSession, path: str, store: sinks.Store, mode: str, checkpoint: str, available_now: bool = True, interval: str = "1 hour", **options) -> StreamingQuery:
    """Read observations (Parquet, with observed_at) as they arrive under ``path`` and apply a mode's step to each micro-batch.

    Change mode takes ``versions`` (source_id, version): the extraction version that is running.
    """
    schema = spark.createDataFrame([], f"{OBSERVATIONS}, observed_at timestamp").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            STEPS[mode](store, batch, number, **options)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
