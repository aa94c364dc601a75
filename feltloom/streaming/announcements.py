"""Announcement sources in the poll cycle: each by its own policy, with the pages of items that it needs.

* ``numbers``: the first poll announces its newest number, later ones every number above that one.
* ``read_once``: the first poll is silent; later a new item is announced, or only remembered, by what its own page says.
* ``window``: an item is announced once its first day, by its own page, is near; until then it is held.
* ``names``: releases by identity and by the names that stand for them, resolved and titled by their players.
* none: once, after a silent first poll.

An item whose page the poll could not read is set aside: it is not booked, stands in the queue of pending pages and is
decided by the first poll that reads it. A page that was throttled fails its source's poll. The first three policies are closed
forms over any number of epochs; ``names`` depends on what was booked before, so it goes epoch by epoch, where the rows
of one page meet in one group (a page is at most 16 MiB) and everything else is a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.model import FEED_ITEMS, HOLD_DAYS, ITEM_LOG, OBSERVATIONS
from feltloom.operators import announce, projection, sinks
from feltloom.operators.gates import body_within_bounds, status_of
from feltloom.plans import flows
from feltloom.sources import html

KEYS, ITEM, AT = ["source_id", "epoch"], ["source_id", "guid"], ["source_id", "epoch", "guid"]
#: The zone whose days screenings are announced by.
ZONE = "Europe/Rome"
OBSERVED = [c.split()[0] for c in OBSERVATIONS.split(", ")] + ["observed_at"]
_PUBLISHED = [c.split()[0] for c in FEED_ITEMS.split(", ")]
_REJECTS = ["source_id", "epoch", "guid", "stage", "reason"]
_WANTED = ["source_id", "epoch", "guid", "purpose", "url", "stage", "reason"]


@dataclass
class Outcome:
    """What a policy makes of its sources: items to publish, identities to book, pages that it lacked, its own state."""

    published: DataFrame
    booked: DataFrame
    wanted: DataFrame | None = None
    state: dict[str, DataFrame] = field(default_factory=dict)


def throttled_epochs(item_log: DataFrame) -> DataFrame:
    """Polls in which an item's page was throttled: that concerns the source, not the item."""
    return item_log.where(status_of(F.col("status")) == "throttled").select(*KEYS).distinct()


def read_pages(item_log: DataFrame) -> DataFrame:
    """source_id, epoch, guid, body of the items' pages that could be read; of several the last."""
    read = item_log.where((F.col("status") == 200) & body_within_bounds(F.col("body")))
    return read.groupBy(*AT).agg(F.max_by("body", "fetched_at").alias("body"))


def whole_polls(observed: DataFrame, item_log: DataFrame | None) -> DataFrame:
    """Observed items without polls that have an item without identity or were throttled; repeated items once."""
    nameless = observed.where("coalesce(guid, '') = ''").select(*KEYS).distinct()
    whole = observed.join(nameless, KEYS, "left_anti")
    if item_log is not None:
        whole = whole.join(throttled_epochs(item_log), KEYS, "left_anti")
    return projection.keep_first(whole.select(*OBSERVED), AT, "ord")


def _published(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pub_date", F.coalesce("pub_date", "observed_at")).select(*_PUBLISHED)


def _wanted(rows: DataFrame, purpose: str, url: str) -> DataFrame:
    return rows.select(*AT, F.lit(purpose).alias("purpose"), F.col(url).alias("url"), F.lit(purpose).alias("stage"), F.coalesce("reason", F.lit("no readable page")).alias("reason"))


def numbers(store: sinks.Store, observed: DataFrame, pages: DataFrame) -> Outcome:
    """The number is what a guid ends with."""
    state = store.table("announce_state")
    numbered = observed.withColumn("number", F.regexp_extract("guid", r"(\d+)$", 1).try_cast("bigint"))
    own = state.join(observed.select("source_id").distinct(), "source_id", "left_semi")
    due = announce.announce_numbers(numbered, own).join(numbered, ["source_id", "number", "epoch"])
    new = announce.unannounced(due, store.table("announced").select(*ITEM), ITEM)
    begun = announce.first_numbers(numbered).join(own, "source_id", "left_anti")
    return Outcome(_published(new), new.select(*ITEM), state={"announce_state": sinks.insert_ignore(state, begun, ["source_id"])})


def once(store: sinks.Store, observed: DataFrame, pages: DataFrame) -> Outcome:
    """Every identity that was not seen before; the first poll books and publishes nothing."""
    new, silent = _unseen(store, observed)
    first = projection.keep_first(new.unionByName(silent).withColumn("place", F.struct("epoch", "ord")), ITEM, "place")
    return Outcome(_published(first.join(silent.select(*AT), AT, "left_anti")), first.select(*ITEM))


def _unseen(store: sinks.Store, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that neither were booked nor stood in a silent first poll, the items of such polls)."""
    booked = store.table("announced")
    begins = observed.groupBy("source_id").agg(F.min("epoch").alias("epoch")).join(booked.select("source_id").distinct(), "source_id", "left_anti")
    silent = observed.join(begins, KEYS, "left_semi")
    return announce.unannounced(announce.unannounced(observed, booked, ITEM), silent, ITEM), silent


def read_once(store: sinks.Store, observed: DataFrame, pages: DataFrame) -> Outcome:
    """Films: a release is announced with its opening and halls, an event is remembered silently."""
    new, silent = _unseen(store, observed)
    notes = flows.film_notes(pages.join(new.select(*AT), AT, "left_semi"), *AT)
    noted = store.cut(new.join(notes, AT, "left")).withColumn("ready", F.col("kind").isNotNull() & F.col("reason").isNull())
    decided, waiting = announce.first_ready(noted, "ready")
    described = decided.where("kind = 'release'").withColumn("description", flows.film_description(F.col("opening"), F.col("halls"))).withColumn("metadata", F.lit(""))
    return Outcome(_published(described), decided.select(*ITEM).unionByName(silent.select(*ITEM)).distinct(), _wanted(waiting, "identity", "link"))


def window(store: sinks.Store, observed: DataFrame, pages: DataFrame) -> Outcome:
    """Screenings: announced when the first day is at most ``HOLD_DAYS`` after the poll's day, else held while on the page."""
    new = announce.unannounced(observed, store.table("announced"), ITEM)
    notes = flows.screening_notes(pages.join(new.select(*AT), AT, "left_semi"), *AT)
    today = F.to_date(F.from_utc_timestamp("observed_at", ZONE))
    noted = store.cut(new.join(notes, AT, "left")).withColumn("ready", F.coalesce(F.col("first_day") <= F.date_add(today, HOLD_DAYS), F.lit(False)))
    decided, waiting = announce.first_ready(noted, "ready")
    described = decided.withColumn("description", flows.screening_description(F.col("first_day"), F.col("director"), F.col("duration"))).withColumn("metadata", F.lit(""))
    last = observed.groupBy("source_id").agg(F.max("epoch").alias("epoch"))
    held = waiting.where("first_day is not null").join(last, KEYS, "left_semi").select(*ITEM, F.col("first_day").alias("day"))
    lacking = waiting.where("first_day is null").withColumn("reason", F.lit(None).cast("string"))
    return Outcome(_published(described), decided.select(*ITEM), _wanted(lacking, "identity", "link"), {"held": sinks.replace_source(store.table("held"), held, last)})


_DECIDED = "source_id string, epoch bigint, guid string, outcome string"


def decide_page(page: pd.DataFrame) -> pd.DataFrame:
    """One page of releases (ord, guid, names, booked, taken, titled) to (guid, outcome) of those that are new.

    An announcement without a title is set aside and the page decided again without it, so that nothing is booked for its sake.
    """
    rest = page.sort_values("ord").reset_index(drop=True)
    aside: list[str] = []
    while True:
        names = rest[["guid", "names"]].explode("names").dropna()
        played = set(names.names[names.guid.str.contains(":album:", regex=False)])
        covered = rest.guid.str.contains(":named:", regex=False) & rest.names.map(lambda own: any(n in played for n in own)).astype(bool)
        new = rest[~rest.booked]
        open_ = new[~(new.taken | covered[new.index])]
        claims = open_[["names"]].explode("names").dropna().rename(columns={"names": "name"}).rename_axis("place").reset_index()
        free = (set(open_.index) - set(claims.place)) | flows.first_holders(claims)
        bare = [i for i in free if not rest.titled[i]]
        if not bare:
            break
        aside += rest.guid[bare].tolist()
        rest = rest.drop(index=bare)
    rows = [(g, "publish" if i in free else "book") for i, g in new.guid.items()] + [(g, "aside") for g in aside]
    first = page.iloc[0]
    return pd.DataFrame([(first.source_id, first.epoch, *r) for r in rows], columns=["source_id", "epoch", "guid", "outcome"])


def _videos(pages: DataFrame) -> DataFrame:
    """source_id, guid, video: titles of videos from what describes them."""
    told = pages.where(F.col("guid").contains(":youtube:")).select(*ITEM, F.from_json("body", "title string, author_name string").alias("v"))
    known = told.where("btrim(v.title) <> '' and btrim(v.author_name) <> ''")
    return known.select(*ITEM, flows.video_title(F.col("v.title"), F.col("v.author_name")).alias("video"))


def names_of_epoch(store: sinks.Store, observed: DataFrame, pages: DataFrame, booked: DataFrame, aliases: DataFrame, tracks: DataFrame) -> dict[str, DataFrame]:
    """One epoch of release pages against the state before it: items with their ``outcome`` and the pages they lacked.

    ``resolved``: each item that has an identity now (``asked``: the guid on the page); ``decided``: outcome by guid;
    ``lost``: items whose player could not be read.
    """
    kind = lambda guid: flows.release_of(F.col(guid))["kind"]
    known = tracks.select("source_id", F.col("track").alias("guid"), F.col("guid").alias("known"))
    items = observed.join(known, ITEM, "left").withColumn("was_track", F.col("known").isNotNull()).withColumn("guid", F.coalesce("known", "guid")).drop("known")
    items = projection.keep_first(items, AT, "ord").join(aliases.withColumnRenamed("names", "known_names"), ITEM, "left").withColumn("asked", F.col("guid"))
    items = items.withColumn("unresolved", (kind("guid") == "track") & ~F.col("was_track") | (kind("guid") == "album") & F.col("known_names").isNull())
    own = pages.join(items.select(*ITEM), ITEM, "left_semi")
    read = flows.resolve_players(items, flows.players(own.where(~F.col("guid").contains(":youtube:")))).join(_videos(own), ITEM, "left")
    read = read.withColumn("title", F.coalesce("video", "title")).withColumn("names", F.when(F.col("unresolved") | F.col("known_names").isNull(), F.col("names")).otherwise(F.col("known_names"))).drop("video", "known_names")
    read = store.cut(read)
    lost = read.where("unresolved and reason is not null")
    resolved = read.where("not (unresolved and reason is not null)")
    page = projection.keep_first(resolved, AT, "ord")
    taken_names = booked.where(F.col("guid").contains(":named:")).select("source_id", flows.release_of(F.col("guid"))["id"].alias("name")).unionByName(aliases.join(booked.select(*ITEM), ITEM, "left_semi").select("source_id", F.explode("names").alias("name"))).distinct()
    taken = page.select(*ITEM, F.explode("names").alias("name")).join(taken_names, ["source_id", "name"], "left_semi").select(*ITEM).distinct().withColumn("taken", F.lit(True))
    asked = page.join(booked.select(*ITEM).withColumn("booked", F.lit(True)), ITEM, "left").join(taken, ITEM, "left").na.fill(False, ["booked", "taken"])
    asked = asked.select(*AT, "ord", "names", "booked", "taken", ((F.coalesce("title", F.lit("")) != "") | F.coalesce(kind("guid") == "named", F.lit(False))).alias("titled"))
    html.importable(observed.sparkSession)
    decided = store.cut(asked.groupBy(*KEYS).applyInPandas(decide_page, _DECIDED))
    return {"resolved": resolved, "page": page, "decided": decided, "lost": lost}


def names(store: sinks.Store, observed: DataFrame, pages: DataFrame) -> Outcome:
    """Release pages, epoch by epoch in the order of polls."""
    booked, aliases, tracks = store.table("announced").select(*ITEM), store.table("aliases"), store.table("tracks")
    before = booked
    published, wanted = [], []
    for epoch in sorted(r.epoch for r in observed.select("epoch").distinct().collect()):  # the polls of one batch
        now = names_of_epoch(store, observed.where(F.col("epoch") == epoch), pages.where(F.col("epoch") == epoch), booked, aliases, tracks)
        out = now["page"].join(now["decided"], AT)
        published.append(_published(out.where("outcome = 'publish'").withColumn("metadata", F.lit(""))))
        address = lambda c: flows.player_url(flows.release_of(F.col(c))["kind"], flows.release_of(F.col(c))["id"])
        wanted.append(_wanted(now["lost"].withColumn("url", address("asked")), "identity", "url"))
        wanted.append(_wanted(out.where("outcome = 'aside'").withColumn("url", address("guid")).withColumn("reason", F.lit("no title")), "metadata", "url"))
        kept = now["resolved"].join(now["decided"].where("outcome = 'aside'").select(*ITEM), ITEM, "left_anti").where("unresolved")
        album = kept.where(F.col("guid").contains(":album:"))
        aliases = store.cut(sinks.upsert(aliases, projection.keep_first(album.select(*ITEM, "ord", "names"), ITEM, "ord").drop("ord"), ITEM))
        tracks = store.cut(sinks.upsert(tracks, kept.where(F.col("asked").contains(":track:")).select("source_id", F.col("asked").alias("track"), "guid").distinct(), ["source_id", "track"]))
        booked = store.cut(sinks.insert_ignore(booked, now["decided"].where("outcome <> 'aside'").select(*ITEM).distinct(), ITEM))
    if not published:
        return once(store, observed, pages)
    return Outcome(reduce(DataFrame.unionByName, published), booked.join(before, ITEM, "left_anti"), reduce(DataFrame.unionByName, wanted), {"aliases": aliases, "tracks": tracks})


POLICIES: dict[str | None, Callable[[sinks.Store, DataFrame, DataFrame], Outcome]] = {None: once, "numbers": numbers, "read_once": read_once, "window": window, "names": names}


def outcomes(store: sinks.Store, observed: DataFrame, policies: DataFrame, item_log: DataFrame) -> tuple[DataFrame, list[Outcome]]:
    """(the polls' items, each policy's outcome over its own sources) before anything is committed."""
    whole = store.cut(whole_polls(observed, item_log))
    pages = read_pages(item_log)
    named = {r.policy: r.n for r in policies.groupBy("policy").agg(F.count("*").alias("n")).collect()}  # a handful of policies
    found = []
    for policy, decide in POLICIES.items():
        if policy in named:
            own = policies.where(F.col("policy").eqNullSafe(policy)).select("source_id")
            found.append(decide(store, whole.join(own, "source_id", "left_semi"), pages.join(own, "source_id", "left_semi")))
    return whole, found


def lacking(found: list[Outcome], item_log: DataFrame) -> DataFrame:
    """source_id, epoch, guid, purpose, url: item pages that these decisions lack and have not asked for yet.

    Pages of identities come first: what an announcement is titled by is asked for when none of its source's are left.
    """
    none = sinks.empty(item_log.sparkSession, "source_id string, epoch bigint, guid string, purpose string, url string")
    wanted = reduce(DataFrame.unionByName, [o.wanted.select(*none.columns) for o in found if o.wanted is not None], none)
    new = wanted.join(item_log.select(*AT).distinct(), AT, "left_anti").distinct()
    first = new.where("purpose = 'identity'")
    return first.unionByName(new.where("purpose <> 'identity'").join(first.select(*KEYS).distinct(), KEYS, "left_anti"))


def step(store: sinks.Store, observed: DataFrame, batch: int | None = None, policies: DataFrame | None = None, item_log: DataFrame | None = None, made: tuple[DataFrame, list[Outcome]] | None = None) -> bool:
    """Commit what the policies (source_id, policy) make of the polls; sources without one are announced once.

    ``item_log``: responses of items' own pages, as ``ITEM_LOG``; ``made``: their outcomes, if they are known.
    """
    spark = observed.sparkSession
    if made is None:
        if policies is None:
            policies = observed.select("source_id").distinct().withColumn("policy", F.lit(None).cast("string"))
        made = outcomes(store, observed, policies, sinks.empty(spark, ITEM_LOG) if item_log is None else item_log)
    whole, found = made
    booked = reduce(DataFrame.unionByName, [o.booked for o in found], sinks.empty(spark, "source_id string, guid string")).withColumn("name", F.lit(None).cast("string"))
    published = reduce(DataFrame.unionByName, [o.published for o in found], sinks.empty(spark, FEED_ITEMS))
    wanted = reduce(DataFrame.unionByName, [o.wanted for o in found if o.wanted is not None], sinks.empty(spark, "source_id string, epoch bigint, guid string, purpose string, url string, stage string, reason string"))
    wanted = store.cut(wanted)
    tables = {
        "feed_items": sinks.insert_ignore(store.table("feed_items"), published, ITEM),
        "announced": sinks.insert_ignore(store.table("announced"), booked, ITEM),
        "pending": announce.pending_queue(store.table("pending"), wanted, whole),
        "rejects": store.table("rejects").unionByName(wanted.select(*_REJECTS)),
    }
    for outcome in found:
        tables |= outcome.state
    return store.commit(tables, batch)
