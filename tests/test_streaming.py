import json
import random

import pytest
from pyspark.sql import functions as F

from feltloom.operators import announce, changes, history, projection
from feltloom.operators.sinks import Store, insert_unique, with_column
from feltloom.plans import flows
from feltloom.streaming import driver, releases

from test_operators import OBS, observed


def epochs_of(seed, n=5):
    draw = random.Random(seed)
    dates = {f"g{i}": draw.randrange(60) for i in range(20)}
    rows = []
    for s in ("s", "t"):
        for e in range(n):
            for i, g in enumerate(draw.sample(sorted(dates), draw.choice([0, 2, 6, 9]))):
                rows.append((s, e, i, g, dates[g], draw.choice([3, 200])))
    return rows


def replay(spark, tmp_path, mode, rows, **options):
    store = Store(spark, f"file://{tmp_path}/store")
    for e in sorted({r[1] for r in rows}):
        observed(spark, [r for r in rows if r[1] == e]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = driver.run_stream(spark, f"{tmp_path}/in", store, mode, f"{tmp_path}/checkpoint", **options)
        query.awaitTermination()
        assert query.exception() is None
    return store


def test_history_replay_is_the_batch_form(spark, tmp_path):
    rows = epochs_of(1)
    store = replay(spark, tmp_path, "history", rows)
    got = {(r.source_id, r.guid) for r in store.table("feed_items").collect()}
    assert got == {(r.source_id, r.guid) for r in history.history(observed(spark, rows)).collect()}
    assert {(r.source_id, r.guid) for r in store.table("live").collect()} == {(r.source_id, r.guid) for r in history.live_items(observed(spark, rows)).collect()}


def test_projection_replay_is_the_batch_form(spark, tmp_path):
    rows = [(s, e, o, g, None if o % 2 else d, r) for s, e, o, g, d, r in epochs_of(2)]
    store = replay(spark, tmp_path, "projection", rows)
    got = {(r.source_id, r.guid, r.pub_date) for r in store.table("feed_items").collect()}
    assert got == {(r.source_id, r.guid, r.pub_date) for r in projection.projection(observed(spark, rows)).collect()}


def test_announcement_replay_is_the_batch_form(spark, tmp_path):
    rows = epochs_of(3)
    store = replay(spark, tmp_path, "announcement", rows)
    got = {(r.source_id, r.guid) for r in store.table("feed_items").collect()}
    assert got == {(r.source_id, r.guid) for r in announce.announce_once(observed(spark, rows)).collect()}


def test_change_replay_is_the_batch_form(spark, tmp_path):
    rows = [(s, e, i, g, d, r) for s, e, i, g, d, r in epochs_of(4, 2)]
    versions = spark.createDataFrame([("s", 1), ("t", 1)], "source_id string, version int")
    store = replay(spark, tmp_path, "change", rows, versions=versions)
    both = observed(spark, rows)
    batch = changes.revisions(changes.change_events(both, both.select("source_id", "epoch").distinct().withColumn("version", F.lit(1))))
    assert {(r.guid, r.title) for r in store.table("feed_items").collect()} == {(r.event_guid, r.kind) for r in batch.collect()}
    whole = Store(spark, f"file://{tmp_path}/whole")  # all epochs in one batch
    assert driver.watch_changes(whole, both, versions, 0)
    assert {r.guid for r in whole.table("feed_items").collect()} == {r.event_guid for r in batch.collect()}
    assert {tuple(r) for r in whole.table("change_state").collect()} == {tuple(r) for r in store.table("change_state").collect()}


def test_announcements_of_several_epochs_at_once(spark, tmp_path):
    rows = epochs_of(5)
    store = Store(spark, f"file://{tmp_path}/store")
    driver.announce_new(store, observed(spark, rows), 0)
    assert {(r.source_id, r.guid) for r in store.table("feed_items").collect()} == {(r.source_id, r.guid) for r in announce.announce_once(observed(spark, rows)).collect()}
    driver.announce_new(store, observed(spark, [("s", 9, 0, "new", 1, 0), ("s", 9, 1, "", 1, 0)]), 1)  # an item without identity: no poll
    assert store.table("feed_items").where("guid = 'new'").count() == 0 == store.table("announced").where("guid = 'new'").count()


def test_changes_step(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    versions = lambda v: spark.createDataFrame([("s", v)], "source_id string, version int")
    poll = lambda e, items: observed(spark, [("s", e, i, g, 1, 0) for i, (g, _) in enumerate(items)]).withColumn("metadata", F.element_at(F.create_map(*[F.lit(x) for p in items for x in p]), F.col("guid")))
    for e, (items, v) in enumerate([([("a", "1"), ("b", "1")], 1), ([("a", "2"), ("c", "1")], 1), ([("a", "2"), ("c", "1")], 1), ([("a", "9")], 2), ([("a", "8")], 2)]):
        assert driver.watch_changes(store, poll(e, items), versions(v), e)
    assert not driver.watch_changes(store, poll(9, [("z", "1")]), versions(2), 4)  # a batch that was committed is passed over
    assert {(r.guid, r.title) for r in store.table("feed_items").collect()} == {("s:1:a", "updated"), ("s:1:b", "removed"), ("s:1:c", "added"), ("s:2:a", "updated")}
    assert store.table("change_state").first().revision == 2


def test_a_failed_commit_leaves_everything(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    driver.keep_history(store, observed(spark, [("s", 0, 0, "a", 1, 1)]), 0)
    before = store.manifest()
    bad = store.table("feed_items").withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit({"live": store.table("live").limit(0), "feed_items": bad}, 1)
    assert store.manifest() == before and store.table("live").count() == 1
    with pytest.raises(Exception, match="repeated key"):
        insert_unique(store.table("live"), store.table("live"), ["source_id", "guid"]).collect()
    assert with_column(store.table("live"), "extra", F.lit(1)).columns == ["source_id", "guid", "extra"]


def test_a_commit_that_dies_before_its_rename_is_not_read(spark, tmp_path, monkeypatch):
    from feltloom.operators import sinks

    monkeypatch.setattr(sinks, "KEPT", 2)
    store = Store(spark, f"file://{tmp_path}/store")
    row = lambda g: spark.createDataFrame([("s", g)], "source_id string, guid string")
    store.commit({"live": row("a")}, 0)

    def die(fs, draft, target):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", die)
        with pytest.raises(OSError, match="lost"):
            store.commit({"live": row("b")}, 1)
    assert [r.guid for r in store.table("live").collect()] == ["a"] and store.manifest()["number"] == 1
    for i in range(1, 5):
        assert store.commit({"live": row(f"c{i}")}, i)
    assert [r.guid for r in store.table("live").collect()] == ["c4"]
    kept = [p for p in (tmp_path / "store" / "manifests").iterdir() if p.suffix == ".json"]
    assert len(kept) == 2 and len([p for p in (tmp_path / "store" / "live").iterdir() if p.name.startswith("v0")]) <= 3
    folder = tmp_path / "store" / "manifests"
    other = Store(spark, f"file://{tmp_path}/store")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, _ = other._fs()
    with pytest.raises(RuntimeError, match="another writer"):
        other._publish(fs, path(f"file://{folder}/x.tmp"), path(f"file://{kept[0]}"))


def test_release_stream_is_the_batch_form(spark, tmp_path):
    draw = random.Random(8)
    rows = []
    for e in range(4):
        for i in range(6):
            k = draw.randrange(5)
            rows.append(("s", e, i, *draw.choice([(f"acloserlisten:bandcamp:album:{k + 1}", [f"a:t{k}", f"a:t{k}ep"]), (f"acloserlisten:named:a:t{k}", [f"a:t{k}"]), (f"acloserlisten:youtube:video00000{k}", [])])))
    schema = "source_id string, epoch bigint, ord int, guid string, names array<string>"
    whole = {(r.epoch, r.guid) for r in flows.announce_releases(spark.createDataFrame(rows, schema)).collect()}
    got = set()
    for e in range(4):
        spark.createDataFrame([r for r in rows if r[1] == e], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = releases.announce_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.epoch, r.guid) for r in spark.read.schema("source_id string, epoch bigint, guid string").parquet(f"{tmp_path}/out").collect()}
    assert got == whole and whole
    with pytest.raises(ValueError, match="unsupported"):
        releases.load_state('{"version": 9}')


def test_an_older_store_is_brought_up_and_a_newer_one_refused(spark, tmp_path, monkeypatch):
    from feltloom.operators import sinks

    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"announced": spark.createDataFrame([("s", "a", None)], "source_id string, guid string, name string")}, 0)
    old = spark.createDataFrame([("s", "a")], "source_id string, guid string")  # as before the column was there
    folder = store.manifest()["tables"]["announced"]
    old.write.mode("overwrite").parquet(f"file://{tmp_path}/store/{folder}")
    written = next((tmp_path / "store" / "manifests").glob("*.json"))
    raw = json.loads(written.read_text())
    (written.parent / f".{written.name}.crc").unlink(missing_ok=True)
    written.write_text(json.dumps({k: v for k, v in raw.items() if k != "versions"}))
    store = Store(spark, f"file://{tmp_path}/store")
    assert [tuple(r) for r in store.table("announced").collect()] == [("s", "a", None)]
    driver.announce_new(store, observed(spark, [("s", 1, 0, "a", 1, 0), ("s", 1, 1, "b", 1, 0)]), 1)
    assert {r.guid for r in store.table("announced").collect()} == {"a", "b"} and store.manifest()["versions"]["announced"] == sinks.STORE_VERSION
    with monkeypatch.context() as m:  # the next version renames
        m.setattr(sinks, "STORE_VERSION", 2)
        m.setattr(sinks, "UPGRADES", sinks.UPGRADES | {1: {"announced": lambda was: was.withColumn("guid", F.upper("guid"))}})
        newer = Store(spark, f"file://{tmp_path}/store")
        assert {r.guid for r in newer.table("announced").collect()} == {"A", "B"}
        newer.commit({"announced": newer.table("announced")}, 2)
        assert {r.guid for r in newer.table("announced").collect()} == {"A", "B"}
    with pytest.raises(ValueError, match="later version"):
        Store(spark, f"file://{tmp_path}/store").table("announced")


assert OBS
