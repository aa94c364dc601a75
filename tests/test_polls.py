import datetime as dt
import json

from pyspark.sql import functions as F

from feltloom.model import ITEM_LOG, PAGE_LOG
from feltloom.operators.sinks import Store
from feltloom.sources import registry
from feltloom.streaming import polls

T0 = dt.datetime(2024, 1, 1)


def response(source, epoch, body, status=200, etag=None, retry=None, page=1):
    return (source, epoch, f"https://h/{source}", page, status, etag, None, retry, body, T0 + dt.timedelta(hours=epoch))


def board(*threads):
    each = [{"no": n, "sub": "/ptg/ - Private Trackers General", "com": com, "time": 1704067200 + n, "resto": 0, "replies": 150, "images": 1} for n, com in threads]
    return json.dumps([{"page": 1, "threads": each}])


def entry(number, notes):
    return {"id": f"e{number}", "alID": number, "notes": notes, "theoreticalBest": "", "comparison": "", "incomplete": False, "trs": [], "expand": {"trs": []}}


def recommended(*entries, total=None):
    return json.dumps({"page": 1, "totalPages": 1, "totalItems": len(entries) if total is None else total, "items": [entry(*e) for e in entries]})


def test_a_poll_commits_sources_of_several_modes_at_once(spark, tmp_path):
    store, sources = Store(spark, f"file://{tmp_path}/store"), registry.sources(spark).where("id in ('ptg', 'film', 'seadex')")
    log = lambda *rows: spark.createDataFrame(rows, PAGE_LOG)
    items = lambda s: {r.guid: r.description for r in store.table("feed_items").where(F.col("source_id") == s).collect()}
    state = lambda: {r.source_id: (r.etag, r.extract_version) for r in store.table("fetch_state").collect()}
    assert polls.poll(store, log(response("ptg", 0, board((1, "one"), (2, "two")), etag="a"), response("seadex", 0, recommended((5, "x"), (6, "y")))), sources, 0)
    assert set(items("ptg")) == {"ptg:1", "ptg:2"} and items("seadex") == {} and state()["ptg"][0] == "a"
    first = state()
    # An incomplete epoch of one source, a throttled one of the other, a body without items: nothing moves.
    bad = log(response("seadex", 1, recommended((5, "z"), total=9)), response("ptg", 1, None, 429, retry="30"), response("film", 1, "[]", etag="f"))
    assert polls.poll(store, bad, sources, 1)
    assert set(items("ptg")) == {"ptg:1", "ptg:2"} and items("seadex") == {} and state() == first
    assert [tuple(r) for r in polls.throttles(bad).collect()] == [("ptg", 1, 30)]
    # A section of one entity changes, another goes that had one; the board answers that nothing changed.
    assert polls.poll(store, log(response("seadex", 2, recommended((5, "z"),)), response("ptg", 2, None, 304, etag="b")), sources, 2)
    assert set(items("seadex")) == {"seadex:1:5", "seadex:1:6"} and "+ z" in items("seadex")["seadex:1:5"] and "- y" in items("seadex")["seadex:1:6"]
    assert state()["ptg"] == ("b", first["ptg"][1]) and store.table("live").count() == 2
    assert not polls.poll(store, log(response("ptg", 3, board((9, "nine")))), sources, 2)  # committed before
    # Another extraction version: stored threads are derived anew from their input, the new one comes.
    broken = store.table("feed_items").withColumn("title", F.when(F.col("source_id") == "ptg", "stale").otherwise(F.col("title")))
    store.commit({"feed_items": broken}, 3)
    newer = sources.withColumn("extract_version", F.col("extract_version") + 1)
    aside = spark.createDataFrame([("ptg", 4, "ptg:7", "metadata", "unreadable")], "source_id string, epoch bigint, guid string, stage string, reason string")
    assert polls.poll(store, log(response("ptg", 4, board((3, "three")))), newer, 4, rejects=aside)
    titles = {r.guid: r.title for r in store.table("feed_items").where("source_id = 'ptg'").collect()}
    assert set(titles) == {"ptg:1", "ptg:2", "ptg:3"} and "stale" not in titles.values()
    assert state()["ptg"] == (None, first["ptg"][1] + 1) and [r.guid for r in store.table("rejects").collect()] == ["ptg:7"]


def test_dates_of_own_pages_are_kept(spark, tmp_path):
    store, sources = Store(spark, f"file://{tmp_path}/store"), registry.sources(spark).where("id = 'coached-essays'")
    page = '<noscript><h2>All essays</h2><a href="/essays/one/">One</a><a href="/essays/two/">Two</a></noscript>'
    log = lambda e: spark.createDataFrame([response("coached-essays", e, page, etag="c")], PAGE_LOG)
    read = lambda *slugs: spark.createDataFrame([("coached-essays", f"coached:essay:{s}", T0) for s in slugs], "source_id string, guid string, ts timestamp")
    polls.poll(store, log(5), sources, 0, read("one"))
    dated = lambda: {r.guid[-3:]: r.pub_date for r in store.table("feed_items").collect()}
    assert dated() == {"one": T0, "two": T0 + dt.timedelta(hours=5)} and store.table("fetch_state").first().etag is None  # a date is missing
    polls.poll(store, log(6), sources, 1, read("two"))
    assert dated() == {"one": T0, "two": T0} and store.table("fetch_state").first().etag == "c" and store.table("item_dates").count() == 2


def test_a_source_that_cannot_be_rebuilt_fails_alone(spark, tmp_path):
    store, sources = Store(spark, f"file://{tmp_path}/store"), registry.sources(spark).where("id in ('ptg', 'film')")
    film = lambda n: board((n, "text")).replace("/ptg/ - Private Trackers General", "/film/ general")
    log = lambda e, n: spark.createDataFrame([response("ptg", e, board((n, "one"))), response("film", e, film(n))], PAGE_LOG)
    assert polls.poll(store, log(0, 1), sources, 0)
    moved = store.table("feed_items").withColumn("pub_date", F.when(F.col("source_id") == "ptg", F.lit(T0)).otherwise(F.col("pub_date")))
    store.commit({"feed_items": moved}, 1)
    before = {r.source_id: r.extract_version for r in store.table("fetch_state").collect()}
    assert polls.poll(store, log(2, 2), sources.withColumn("extract_version", F.col("extract_version") + 1), 2)
    assert {r.guid for r in store.table("feed_items").collect()} == {"ptg:1", "film:1", "film:2"}
    assert [tuple(r)[:4] for r in store.table("rejects").collect()] == [("ptg", 2, "ptg:1", "rebuild")]
    after = {r.source_id: r.extract_version for r in store.table("fetch_state").collect()}
    assert after == {"ptg": before["ptg"], "film": before["film"] + 1}


def test_changes_are_titled_all_or_nothing(spark, tmp_path):
    store, sources = Store(spark, f"file://{tmp_path}/store"), registry.sources(spark).where("id = 'seadex'")
    log = lambda e, *entries: spark.createDataFrame([response("seadex", e, recommended(*entries), etag=f"e{e}")], PAGE_LOG)
    asked, broken = [], set()

    def read(wanted):
        rows = []
        for r in wanted.collect():
            asked.append((r.epoch, r.guid, r.url))
            facts = json.dumps({"items": [{"alID": n, "title_english": f"Show {n}", "coverImage_medium": f"https://c/{n}.png"} for n in range(1, 200) if f"alID%3D{n}" in r.url and n % 2]})
            rows.append((r.source_id, r.epoch, r.guid, r.url, 500 if r.guid in broken else 200, None, None if r.guid in broken else facts, T0))
        return spark.createDataFrame(rows, ITEM_LOG)

    many = lambda note: [(n, note) for n in range(1, 61)]
    assert polls.poll_cycle(store, read, log(0, *many("x")), sources, 0) and asked == []  # a silent baseline asks for nothing
    broken.add("1")
    assert polls.poll_cycle(store, read, log(1, *many("y")), sources, 1)
    assert [(e, g) for e, g, _ in sorted(asked)] == [(1, "0"), (1, "1")] and sum(u.count("alID%3D") for *_, u in asked) == 60
    state = lambda: (store.table("feed_items").count(), store.table("change_state").first().revision, store.table("fetch_state").first().etag)
    assert state() == (0, 0, "e0") and [r.reason for r in store.table("rejects").collect()] == ["a lookup is missing"]
    broken.clear()
    assert polls.poll_cycle(store, read, log(2, *many("y")), sources, 2)  # the same comparison again
    assert state() == (60, 1, "e2")
    titles = {r.guid: (r.title, r.description[:18]) for r in store.table("feed_items").collect()}
    assert titles["seadex:1:7"][0].endswith("Show 7") and titles["seadex:1:7"][1] == '<img src="https://' and "AniList 8" in titles["seadex:1:8"][0]
