"""Poll cycles: responses from the page log to one commit of all sources, whatever their mode.

A source's epoch counts if all its pages were read within bounds and gave items. Extraction runs once; each mode's
step then works on its own sources' items, and everything is committed together: items, live sets, baselines, what
was announced, dates of items' own pages, rejects, validators and extraction versions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.model import ITEM_LOG
from feltloom.operators import announce, gates, rebuild, sinks
from feltloom.plans import flows
from feltloom.sources import pages
from feltloom.streaming import announcements, driver

KEYS = ["source_id", "epoch"]
ITEM_KEYS = ["source_id", "guid"]
#: Sources whose items are dated by their own pages; the boards, whose stored threads can be derived anew.
DATED, BOARDS = ["coached-essays"], ["ptg", "film"]
#: Sources whose changes are titled by lookups.
LOOKED_UP = ["seadex"]
_THREAD = "struct<no:bigint,sub:string,com:string,time:bigint,resto:bigint,replies:int,images:int>"


def observations(log: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(observations of successful epochs of the named sources with observed_at, these epochs) of a page log."""
    fits, _ = pages.bounded(log)
    read = fits.where("status = 200")
    found = reduce(DataFrame.unionByName, [extract(read.where(F.col("source_id") == name)) for name, extract in flows.FLOWS.items() if name in names])
    broken = None
    if "seadex" in names:
        numbered = flows.recommendation_pages(read.where("source_id = 'seadex'"))
        broken = gates.pages_complete(numbered).where("not complete").select(*KEYS).union(numbered.where("not coalesce(sound, false)").select(*KEYS)).distinct()
    good = gates.successful_epochs(log, found, broken)
    at = log.groupBy(*KEYS).agg(F.min("fetched_at").alias("observed_at"))
    return found.join(good, KEYS, "left_semi").join(at, KEYS), good


def throttles(log: DataFrame) -> DataFrame:
    """source_id, epoch, wait_s: polls that any page throttled, with the longest wait that one asked for (0: none)."""
    return pages.classified(log).where("outcome = 'throttled'").groupBy(*KEYS).agg(F.max("wait_s").alias("wait_s"))


def rebuilt_threads(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored threads derived anew from their saved input, rows whose identity or date would change); those without an input stay."""
    saved = stored.where(~rebuild.is_legacy(F.col("metadata"))).select("source_id", F.lit(0).cast("bigint").alias("epoch"), F.lit(0).alias("ord"), F.col("metadata").alias("saved"), F.from_json("metadata", _THREAD).alias("t"))
    made = reduce(DataFrame.unionByName, [flows.thread_items(saved.where(F.col("source_id") == b), b) for b in BOARDS])
    was = stored.select(*ITEM_KEYS, F.col("pub_date").alias("was"))
    compared = made.join(was, ITEM_KEYS, "left")
    same = F.coalesce(F.col("was") == F.col("pub_date"), F.lit(False))
    return compared.where(same).select(*driver.ITEM), compared.where(~same).select(*ITEM_KEYS, F.lit("rebuild").alias("stage"), F.lit("a rebuilt row changes its identity or date").alias("reason"))


def fetch_state(stored: DataFrame, log: DataFrame, good: DataFrame, sources: DataFrame, pending: DataFrame) -> DataFrame:
    """source_id, etag, last_modified, extract_version after the log's epochs.

    Successful epochs and answers that nothing changed count, but not the latter for a source that needs the whole
    page. Only a successful epoch advances the version. Sources of ``pending`` lose their validators: an
    unchanged page would put off what they still have to read.
    """
    heads = log.groupBy(*KEYS).agg(F.min_by(F.struct("status", "etag", "last_modified"), "page_no").alias("h")).select(*KEYS, "h.*")
    running = sources.select(F.col("id").alias("source_id"), F.col("extract_version").alias("running"), F.coalesce("needs_full_page", F.lit(False)).alias("whole"))
    counted = heads.join(good.withColumn("good", F.lit(True)), KEYS, "left").join(running, "source_id").where("good or status = 304 and not whole")
    prior = stored.select("source_id", F.lit(-1).cast("bigint").alias("epoch"), F.lit(200).alias("status"), "etag", "last_modified").join(counted.select("source_id").distinct(), "source_id", "left_semi")
    force = gates.validators(prior.unionByName(counted.select(prior.columns)))
    last = force.groupBy("source_id").agg(F.max_by(F.struct("etag", "last_modified"), "epoch").alias("v"))
    made = counted.groupBy("source_id").agg(F.max(F.when(F.col("good"), F.col("running"))).alias("made"))
    old = stored.select("source_id", F.col("extract_version").alias("old"))
    waits = pending.select("source_id", F.lit(True).alias("waits"))
    kept = lambda c: F.when(F.col("waits").isNull(), F.col(f"v.{c}")).alias(c)
    joined = last.join(made, "source_id").join(old, "source_id", "left").join(waits, "source_id", "left")
    return joined.select("source_id", kept("etag"), kept("last_modified"), F.coalesce("made", "old").cast("int").alias("extract_version"))


def running_versions(sources: DataFrame) -> DataFrame:
    """source_id, version: the extraction version that runs."""
    return sources.select(F.col("id").alias("source_id"), F.col("extract_version").alias("version"))


def announcing(sources: DataFrame) -> DataFrame:
    """source_id, policy of the announcement sources."""
    return sources.where("mode = 'announcement'").select(F.col("id").alias("source_id"), "policy")


def lookup_batches(store: sinks.Store, found: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, epoch, guid (the batch's number), purpose, url: lookups of what changed, fifty changes in order at a time."""
    own = found.where(F.col("source_id").isin(LOOKED_UP))
    numbered, _ = driver.numbered_changes(store, own, running_versions(sources))
    last = F.lit((1 << 31) - 1)  # what left the page comes after what is on it
    placed = numbered.select(*KEYS, "guid").join(own.select(*KEYS, "guid", "ord"), [*KEYS, "guid"], "left").select(*KEYS, "guid", F.struct(F.coalesce("ord", last).alias("ord"), "guid").alias("place"))
    batched = announce.batches(placed, KEYS, "place")
    in_order = F.transform(F.array_sort(F.collect_list("place")), lambda x: x["guid"])  # fifty at most
    each = batched.groupBy(*KEYS, "batch").agg(in_order.alias("guids"))
    return each.select(*KEYS, F.col("batch").cast("string").alias("guid"), F.lit("lookup").alias("purpose"), flows.lookup_url(F.col("guids")).alias("url"))


def answered(lookups: DataFrame) -> DataFrame:
    """Responses of lookups (``ITEM_LOG``) that hold records, be they none."""
    return lookups.where((F.col("status") == 200) & F.get_json_object("body", "$.items").isNotNull())


def poll(store: sinks.Store, log: DataFrame, sources: DataFrame, batch: int | None = None, page_dates: DataFrame | None = None, rejects: DataFrame | None = None, item_log: DataFrame | None = None, observed: tuple[DataFrame, DataFrame] | None = None, made: tuple | None = None, lookups: DataFrame | None = None) -> bool:
    """Commit a page log's epochs. False if ``batch`` was committed before.

    ``sources``: the registry. ``page_dates`` (source_id, guid, ts): dates read on items' own pages; ``rejects``: items
    set aside before, which are committed beside bodies out of bounds; ``item_log``: responses of the pages that
    ``poll_cycle`` asked for; ``observed`` and ``made``: the log's observations and what announcements make of them, if
    that is known. A poll one of whose item pages was throttled counts as failed. ``lookups``: responses of ``lookup_batches``; a
    source that lacks one of them publishes nothing and keeps its baseline, so that its next poll makes the same comparison.
    """
    mode_of = sources.select(F.col("id").alias("source_id"), "mode")
    configured = sources.select("id", "mode").collect()
    found, good = observed or observations(log, [r.id for r in configured])
    if item_log is not None:
        waits = announcements.throttled_epochs(item_log)
        good, found = good.join(waits, KEYS, "left_anti"), found.join(waits, KEYS, "left_anti")
    if observed is None or item_log is not None:
        good, found = store.cut(good), store.cut(found)
    stored, items = store.table("fetch_state"), store.table("feed_items")
    stale = rebuild.needs_rebuild(stored, sources).where(F.col("id").isin(BOARDS)).select(F.col("id").alias("source_id"))
    # A source with a stored row that can't be rebuilt fails alone: it is as if it had not been polled, and says why.
    rebuilt, wrong = rebuilt_threads(items.join(stale, "source_id", "left_semi")) if any(r.mode == "history" for r in configured) else (None, None)
    if wrong is not None:
        wrong = store.cut(wrong.join(good.groupBy("source_id").agg(F.max("epoch").alias("epoch")), "source_id"))
        found, good = (x.join(wrong.select("source_id").distinct(), "source_id", "left_anti") for x in (found, good))
    titled = None
    if lookups is not None:
        read = store.cut(answered(lookups))
        lacking = store.cut(lookup_batches(store, found, sources).join(read.select(*KEYS, "guid"), [*KEYS, "guid"], "left_anti").select(*KEYS))
        found, good = (x.join(lacking.select("source_id").distinct(), "source_id", "left_anti") for x in (found, good))
        rejects = reduce(DataFrame.unionByName, [r for r in (rejects, lacking.distinct().select(*KEYS, F.lit("").alias("guid"), F.lit("metadata").alias("stage"), F.lit("a lookup is missing").alias("reason"))) if r is not None])
        facts = flows.lookup_facts(read, *KEYS)
        titled = lambda rows: flows.with_anime_titles(rows, facts)
    dates = store.table("item_dates")
    if page_dates is not None:
        dates = sinks.upsert(dates, page_dates.select(*ITEM_KEYS, "ts"), ITEM_KEYS)
    # Each mode has its own sources, so its step sees and gives back these sources' items alone.
    tables, parts = {}, [items.join(mode_of, "source_id", "left_anti")]
    options_of = {
        "projection": dict,
        "history": lambda: {"rebuilt": rebuilt},
        "change": lambda: {"versions": running_versions(sources), "titled": titled},
        "announcement": lambda: {"policies": announcing(sources), "item_log": item_log, "made": made},
    }
    for mode in [m for m in options_of if m in {r.mode for r in configured}]:
        own = mode_of.where(F.col("mode") == mode).select("source_id")
        draft = sinks.Draft(store, {"feed_items": items.join(own, "source_id", "left_semi"), "item_dates": dates})
        STEPS[mode](draft, found.join(own, "source_id", "left_semi"), batch, **options_of[mode]())
        parts.append(draft.changed["feed_items"].select(*driver.ITEM))
        tables |= {name: frame for name, frame in draft.changed.items() if name != "item_dates"}
    undated = found.where(F.col("source_id").isin(DATED) & F.col("pub_date").isNull()).join(dates, ITEM_KEYS, "left_anti")
    state = fetch_state(stored, log, good, sources, undated.select("source_id").distinct())
    _, large = pages.bounded(log)
    set_aside = [r.select("source_id", "epoch", "guid", "stage", "reason") for r in (large, rejects, wrong) if r is not None]
    tables |= {"feed_items": reduce(DataFrame.unionByName, parts), "fetch_state": sinks.upsert(stored, state, ["source_id"]), "rejects": reduce(DataFrame.unionByName, set_aside, tables.get("rejects", store.table("rejects")))}
    if page_dates is not None:
        tables["item_dates"] = dates
    return store.commit(tables, batch)


#: The steps of a poll cycle: announcement sources go by their policies here.
STEPS = driver.STEPS | {"announcement": announcements.step}


def poll_cycle(store: sinks.Store, read: Callable[[DataFrame], DataFrame], log: DataFrame, sources: DataFrame, batch: int | None = None) -> bool:
    """A poll with all that follows from it: item pages are asked for until no decision lacks one, then all is committed.

    ``read`` takes requests (source_id, epoch, guid, purpose, url) and gives their responses as ``ITEM_LOG``. What it
    can't read is set aside, so each round asks for pages that were not asked for before, and the rounds end.
    """
    own, item_log, lookups = announcing(sources), sinks.empty(store.spark, ITEM_LOG), None
    names = [r.id for r in sources.select("id").collect()]
    found, good = (store.cut(x) for x in observations(log, names))
    if set(names) & set(LOOKED_UP):
        lookups = store.cut(read(store.cut(lookup_batches(store, found, sources))))
    announced = found.join(own, "source_id", "left_semi")
    while True:
        made = announcements.outcomes(store, announced, own, item_log)
        wanted = store.cut(announcements.lacking(made[1], item_log))
        if wanted.isEmpty():
            return poll(store, log, sources, batch, item_log=item_log, observed=(found, good), made=made, lookups=lookups)
        item_log = store.cut(item_log.unionByName(read(wanted)))
