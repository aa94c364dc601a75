import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from feltloom.functions.sanitize import safe_html
from feltloom.model import DOCUMENTS, FEED_ITEMS
from feltloom.operators import announce, changes, gates, history, pacing, projection, rebuild, render
from feltloom.sources import registry

T0 = dt.datetime(2024, 1, 1)
OBS = "source_id string, epoch bigint, ord int, guid string, title string, link string, description string, metadata string, pub_date timestamp, replies int, observed_at timestamp"


def observed(spark, rows):
    """rows: (source, epoch, ord, guid, day of pub_date or None, replies)."""
    full = [(s, e, o, g, f"t{g}", f"/{g}", "", "", T0 + dt.timedelta(days=d) if d is not None else None, r, T0 + dt.timedelta(days=100 + e)) for s, e, o, g, d, r in rows]
    return spark.createDataFrame(full, OBS)


def simulate_history(epochs, stored):
    kept, live = {}, set()
    for items in epochs:
        if not items:
            continue
        kept.update({g: d for g, d in items})
        live = {g for g, _ in items}
        top = sorted(kept, key=lambda g: (-kept[g], g))[:stored]
        kept = {g: d for g, d in kept.items() if g in live or g in top}
    return kept, live


def test_history_batch_form_is_the_simulation(spark):
    draw = random.Random(4)
    for _ in range(3):
        dates = {f"g{i}": draw.randrange(40) for i in range(25)}
        epochs = [[(g, dates[g]) for g in draw.sample(sorted(dates), draw.choice([0, 3, 6]))] for _ in range(7)]
        rows = [("s", e, i, g, d, 5) for e, items in enumerate(epochs) for i, (g, d) in enumerate(items)]
        if not rows:
            continue
        got = history.history(observed(spark, rows), 8).collect()
        kept, live = simulate_history(epochs, 8)
        assert {r.guid for r in got} == set(kept) and {r.guid for r in got if r.live} == live


def test_visible_hides_immature_live_items(spark):
    rows = [("s", 0, 0, "old", 1, 5), ("s", 1, 0, "live-young", 9, 99), ("s", 1, 1, "live-mature", 8, 100)]
    items = history.history(observed(spark, rows))
    assert [r.guid for r in history.visible(items).orderBy("place").collect()] == ["live-mature", "old"]


def test_projection(spark):
    rows = [("s", 0, 0, "a", None, 0), ("s", 1, 1, "a", None, 0), ("s", 1, 0, "a", 3, 1), ("s", 1, 2, "b", None, 0), ("s", 1, 3, "", 1, 0), ("t", 5, 0, "z", 1, 0)]
    got = {r.guid: r for r in projection.projection(observed(spark, rows)).collect()}
    assert set(got) == {"a", "b", "z"} and got["a"].replies == 1 and got["a"].pub_date == T0 + dt.timedelta(days=3)
    assert got["b"].pub_date == T0 + dt.timedelta(days=101) and got["b"].pending and not got["z"].pending


def test_changes(spark):
    rows = [("s", 0, "a", "1"), ("s", 0, "b", "1"), ("s", 2, "a", "2"), ("s", 2, "c", "1"), ("s", 3, "a", "2"), ("s", 3, "c", "1"), ("s", 5, "a", "3"), ("s", 5, "c", "1"), ("s", 6, "c", "1")]
    obs = spark.createDataFrame(rows, "source_id string, epoch bigint, guid string, metadata string")
    epochs = spark.createDataFrame([("s", 0, 1), ("s", 2, 1), ("s", 3, 1), ("s", 5, 2), ("s", 6, 2)], "source_id string, epoch bigint, version int")
    got = {(r.epoch, r.guid, r.kind, r.event_guid) for r in changes.revisions(changes.change_events(obs, epochs)).collect()}
    # epoch 5 is another version: a silent baseline; the revision goes on after it
    assert got == {(2, "a", "updated", "s:1:a"), (2, "b", "removed", "s:1:b"), (2, "c", "added", "s:1:c"), (6, "a", "removed", "s:2:a")}


def test_sections_and_stack_events(spark):
    fields = "best array<string>, alt array<string>, unmuxed_best array<string>, notes array<string>, tags array<string>, dual_audio array<string>, incomplete array<string>, comparisons array<string>, releases array<string>"
    new = {"best": ["A"], "notes": ["x", "y<"], "tags": None}
    schema = f"source_id string, epoch bigint, guid string, kind string, old struct<{fields.replace(' array', ':array')}>, new struct<{fields.replace(' array', ':array')}>"
    blank = dict.fromkeys([f.split()[0] for f in fields.split(", ")])
    frame = spark.createDataFrame([("s", 1, "1", "updated", blank | {"best": ["A"], "notes": ["x"]}, blank | new), ("s", 1, "2", "added", None, blank)], schema)
    got = changes.section_events(frame).collect()
    assert [(r.guid, r.description) for r in got] == [("1", '<h3>Notes</h3><pre style="white-space:pre-wrap"><span style="color:#067647">+ y&lt;</span></pre>')]
    card = "struct<title:string,notes:array<string>>"
    rows = [("s", 1, "5", "added", None, ("T", ["n"])), ("s", 1, "6", "removed", ("U", []), None), ("s", 1, "7", "updated", ("V", ["a"]), ("V", ["b"])), ("s", 1, "8", "updated", ("W", ["a"]), ("X", ["a"]))]
    events = changes.stack_events(spark.createDataFrame(rows, f"source_id string, epoch bigint, guid string, kind string, old {card}, new {card}"), "https://h/anime/")
    got = {r.guid: (r.title, r.description) for r in events.collect()}
    assert got == {
        "5": ("Added: T", '<p>Added to the stack.</p><h3>Notes</h3><pre style="white-space:pre-wrap">n</pre>'),
        "6": ("Removed: U", "<p>Removed from the stack.</p>"),
        "7": ("Notes updated: V", '<p>Notes changed.</p><pre style="white-space:pre-wrap">- a\n+ b</pre>'),
    }


def test_announcements(spark):
    numbers = spark.createDataFrame([("s", 0, 5), ("s", 0, 7), ("s", 1, 7), ("s", 1, 9), ("s", 2, 8), ("s", 2, 6)], "source_id string, epoch bigint, number int")
    assert {(r.number, r.epoch) for r in announce.announce_numbers(numbers).collect()} == {(7, 0), (9, 1), (8, 2)}
    seen = spark.createDataFrame([("s", 0, "a", "release"), ("s", 1, "b", "event"), ("s", 2, "b", "release"), ("s", 1, "c", "release")], "source_id string, epoch bigint, guid string, kind string")
    assert {(r.guid, r.epoch) for r in announce.announce_once(seen, F.col("kind") == "release").collect()} == {("c", 1)}
    named = spark.createDataFrame([("s", "x", ["n1"]), ("s", "y", ["n2", "n3"]), ("s", "z", [])], "source_id string, guid string, names array<string>")
    booked = spark.createDataFrame([("s", "n3"), ("t", "n1")], "source_id string, name string")
    assert {r.guid for r in announce.unannounced_names(named, booked).collect()} == {"x", "z"}
    ready, rejects = announce.quarantine(named, F.size("names") == 0, "identity", F.lit("no names"))
    assert ready.count() == 2 and [r.reason for r in rejects.collect()] == ["no names"]


def test_gates(spark):
    pages = "source_id string, epoch bigint, page int, total_pages int, total_items int, ids array<string>"
    ab = ["a", "b"]
    rows = [("s", 0, 1, 2, 3, ab), ("s", 0, 2, 2, 3, ["c"]), ("s", 1, 1, 2, 3, ab), ("s", 2, 1, 2, 3, ab), ("s", 2, 2, 2, 4, ["c"]), ("s", 3, 1, 1, 2, ["a", "a"]), ("s", 4, 1, 0, 0, [])]
    rows += [("s", 5, 1, 2, 4, ab), ("s", 5, 2, 2, 4, ab), ("s", 6, 1, 1, 2, ["a", ""]), ("s", 7, 1, 1, 2, ["a", None]), ("s", 8, 1, 1, 0, None)]
    got = {r.epoch: r.complete for r in gates.pages_complete(spark.createDataFrame(rows, pages)).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True}
    seen = spark.createDataFrame([("s", 1, "g"), ("s", 2, ""), ("s", 3, None)], "source_id string, epoch bigint, guid string")
    assert [r.guid for r in history.live_items(seen).collect()] == ["g"]
    log = [("s", 0, 200, "e1", "m1", "x"), ("s", 1, 304, None, None, None), ("s", 2, 304, "e2", None, None), ("s", 3, 200, None, None, "x"), ("s", 4, 429, None, None, None)]
    frame = spark.createDataFrame(log, "source_id string, epoch bigint, status int, etag string, last_modified string, body string")
    assert {r.epoch: (r.etag, r.last_modified) for r in gates.validators(frame).collect()} == {0: ("e1", "m1"), 1: ("e1", "m1"), 2: ("e2", "m1"), 3: (None, None), 4: (None, None)}
    obs = spark.createDataFrame([("s", 0), ("s", 1), ("s", 4)], "source_id string, epoch bigint")
    assert {r.epoch for r in gates.successful_epochs(frame, obs).collect()} == {0}
    with pytest.raises(Exception, match="repeated key"):
        gates.unique_or_fail(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_registry(spark):
    rows = registry.sources(spark)
    assert rows.count() == 11 and {r.mode for r in rows.select("mode").distinct().collect()} == {"projection", "history", "change", "announcement"}
    for bad in ({"id": ""}, {"url": "ftp://x"}, {"mode": "x"}, {"mode": "history"}, {"meta": {"title": ""}}):
        with pytest.raises(ValueError):
            gates.validate_sources([registry.REGISTERED[0] | bad])
    with pytest.raises(ValueError):
        gates.validate_sources(registry.REGISTERED[:1] * 2)


def test_pacing(spark):
    draw = random.Random(2)
    rows, expected = [], {}
    for d in range(3):
        start, at = None, 0
        for i in range(40):
            at += draw.randint(0, 12)
            start = at if start is None else max(at, start + 10)
            rows.append((d, i, at))
            expected[d, i] = start
    frame = spark.createDataFrame(rows, "d int, i int, at bigint")
    assert {(r.d, r.i): r.start for r in pacing.spaced(frame, "d", ["at", "i"], F.col("at"), 10).collect()} == expected
    kinds = [(i, draw.choice(["ok", "fail", "throttle", "throttle"]), draw.choice([0, 0, 0, 7])) for i in range(60)]
    backoff, loop, plain = 0, [], []
    for _, k, wait in kinds:
        if k == "throttle":
            backoff = wait or (60 if backoff <= 0 else min(backoff * 2, 3600))
        elif k == "ok":
            backoff = 0
        loop.append(backoff)
    one = spark.createDataFrame([([{"kind": k, "retry_after": w} for _, k, w in kinds],)], "o array<struct<kind:string,retry_after:bigint>>")
    assert one.select(pacing.backoffs(F.col("o"))).first()[0] == loop
    backoff = 0
    for _, k, _w in kinds:
        backoff = (60 if backoff <= 0 else min(backoff * 2, 3600)) if k == "throttle" else 0 if k == "ok" else backoff
        plain.append(backoff)
    frame = spark.createDataFrame([(0, i, k) for i, k, _ in kinds], "d int, i int, k string")
    assert [r.backoff for r in pacing.doubling_backoff(frame, "d", ["i"], F.col("k")).orderBy("i").collect()] == plain


def test_rendering(spark):
    sources = registry.sources(spark).where("id in ('seadex', 'one-piece', 'ptg')")
    items = spark.createDataFrame([("seadex", "1", "A & B", "https://x/?a=1&b", "<p>ok<script>no</script></p>", T0), ("seadex", "0", "newer", "l", "", T0 + dt.timedelta(days=1)), ("one-piece", "g", "t", "l", "<b>raw</b>", T0)], "source_id string, guid string, title string, link string, description string, pub_date timestamp")
    made = {r.source_id: r for r in render.rss_feeds(sources, items).collect()}
    body = made["seadex"].body
    assert body.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n  <channel>\n    <title>SeaDex') and body.index("newer") < body.index("A &amp; B")
    assert '<guid isPermaLink="false">1</guid>' in body and "<pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate>" in body and len(made["ptg"].etag) == 32
    assert "<item>" not in made["ptg"].body
    shown = items.withColumn("description", safe_html("description"))
    html = {r.source_id: r.body for r in render.html_feeds(sources, items.where("source_id <> 'seadex'").unionByName(shown.where("source_id = 'seadex'"))).collect()}
    assert "<p>ok</p>" in html["seadex"] and "&lt;b&gt;raw&lt;/b&gt;" in html["one-piece"] and "No items yet." in html["ptg"] and "1 January 2024" in html["seadex"]
    assert "/feeds/ptg.xml" in render.html_index(sources).first().body
    assert render.render_feed(sources, items, "nope", "xml") is None and render.render_feed(sources, items, "ptg", "pdf") is None and render.render_feed(sources, items, "one-piece", "xml")[0] == made["one-piece"].body


def test_rebuild(spark):
    rows = [("1", "old", '{"no":1,"sub":"new"}'), ("2", "kept", ""), ("3", "kept", '{"legacy":true}'), ("4", "kept", "{broken")]
    stored = spark.createDataFrame(rows, "guid string, title string, metadata string")
    made = rebuild.rebuild(stored, "no bigint, sub string", lambda x: {"title": x["sub"], "guid": x["no"].cast("string")}, ["title"])
    assert {r.guid: (r.title, r.rebuilt) for r in made.collect()} == {"1": ("new", True), "2": ("kept", False), "3": ("kept", False), "4": ("kept", False)}
    moved = spark.createDataFrame([("9", "old", '{"no":1,"sub":"new"}')], stored.schema)
    with pytest.raises(Exception, match="changes its guid"):
        rebuild.rebuild(moved, "no bigint, sub string", lambda x: {"title": x["sub"], "guid": x["no"].cast("string")}, ["title"]).collect()


def test_enrichment_rules(spark):
    asked = spark.createDataFrame([("s", 0, 0, 50), ("s", 0, 1, 3), ("s", 1, 0, 2), ("t", 0, 0, 1)], "source_id string, epoch bigint, batch bigint, n bigint")
    read = spark.createDataFrame([("s", 0, 0, 50), ("s", 0, 1, 3), ("s", 1, 0, 1)], "source_id string, epoch bigint, batch bigint, n bigint")
    assert {(r.source_id, r.epoch): r.ok for r in announce.every_batch_read(asked, read).collect()} == {("s", 0): True, ("s", 1): False, ("t", 0): False}
    numbered = announce.batches(spark.range(120).select(F.lit("s").alias("source_id"), "id"), ["source_id"], "id")
    assert {r.batch: r["count"] for r in numbered.groupBy("batch").count().collect()} == {0: 50, 1: 50, 2: 20}
    pair = spark.createDataFrame([("a", "a"), ("b", "c")], "x string, y string")
    assert pair.where("x = 'a'").select(announce.same_identity(F.col("x"), F.col("y"))).first()[0] == "a"
    with pytest.raises(Exception, match="changes the identity"):
        pair.select(announce.same_identity(F.col("x"), F.col("y"))).collect()


def test_small_text_functions(spark):
    from feltloom.functions import text

    frame = spark.createDataFrame([("1 Entries of 12 Entries", "v1.10.0"), ("none", "1.9"), ("3 Entry", "1.9.9")], "x string, v string")
    got = frame.select(text.last_match("x", "([0-9]+)\\s+Entr(?:y|ies)").alias("n"), text.version_parts("v").alias("v")).collect()
    assert [r.n for r in got] == ["12", None, "3"] and got[1].v is None and tuple(got[0].v) == (1, 10, 0)
    assert frame.where("v <> '1.9'").agg(F.max(text.version_parts("v"))).first()[0] == (1, 10, 0)


def test_only_stale_feeds_are_rendered(spark):
    sources = registry.sources(spark).where("id in ('one-piece', 'ptg', 'seadex')")
    rows = [(s, f"{s}:{i}", f"T{i}", "https://x/", "d", "", dt.datetime(2024, 1, 1 + i), 0) for s in ("one-piece", "ptg", "gone") for i in range(3)]
    frame = lambda r: spark.createDataFrame(r, FEED_ITEMS)
    first = render.refreshed(spark.createDataFrame([], DOCUMENTS), sources, frame(rows)).collect()
    assert {(r.source_id, r.kind) for r in first} == {(s, k) for s in ("one-piece", "ptg", "seadex") for k in ("xml", "html")}
    marked = spark.createDataFrame([(*r[:3], "as it was", r.etag) for r in first], DOCUMENTS)
    again = render.refreshed(marked, sources, frame(rows[::-1])).collect()  # the same items in another order
    assert {r.body for r in again} == {"as it was"}
    changed = [r if r[1] != "ptg:1" else (*r[:2], "Other", *r[3:]) for r in rows]
    assert {r.source_id for r in render.stale_feeds(marked, sources, frame(changed)).collect()} == {"ptg"}
    third = render.refreshed(marked, sources.where("id <> 'seadex'"), frame(changed)).collect()
    assert {(r.source_id, r.body == "as it was") for r in third} == {("one-piece", True), ("ptg", False)} and len(third) == 4
    back = {(r.source_id, r.kind): r.etag for r in render.refreshed(spark.createDataFrame([tuple(r) for r in third], DOCUMENTS), sources, frame(rows)).collect()}
    assert back == {(r.source_id, r.kind): r.etag for r in first}  # equal content has its tag again
