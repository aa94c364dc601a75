import datetime as dt
import json
import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from feltloom.model import ITEM_LOG, PAGE_LOG
from feltloom.operators import announce
from feltloom.operators.sinks import Store
from feltloom.plans import flows
from feltloom.sources import registry
from feltloom.streaming import announcements, polls

from test_operators import observed

T0 = dt.datetime(2024, 10, 1, 12)


def at(epoch):
    return T0 + dt.timedelta(days=epoch)


def main_page(source, epoch, body):
    return (source, epoch, f"https://h/{source}", 1, 200, None, None, None, body, at(epoch))


class Site:
    """Item pages by guid; what isn't there can't be read. Keeps what was asked for."""

    def __init__(self, spark, pages=()):
        self.spark, self.pages, self.asked = spark, dict(pages), []

    def read(self, wanted):
        rows = []
        for r in wanted.collect():
            self.asked.append((r.epoch, r.guid, r.purpose))
            found = self.pages.get(r.guid, (404, None))
            status, body = found if isinstance(found, tuple) else (200, found)
            rows.append((r.source_id, r.epoch, r.guid, r.url, status, None, body, at(r.epoch)))
        return self.spark.createDataFrame(rows, ITEM_LOG)


class Feed:
    """Sources polled epoch by epoch, all in one commit."""

    def __init__(self, spark, tmp_path, sources, site):
        self.spark, self.epoch, self.site = spark, 0, site
        self.store = Store(spark, f"file://{tmp_path}/store")
        self.sources = registry.sources(spark).where(F.col("id").isin(sources))

    def poll(self, **bodies):
        log = self.spark.createDataFrame([main_page(s.replace("_", "-"), self.epoch, b) for s, b in bodies.items()], PAGE_LOG)
        polls.poll_cycle(self.store, self.site.read, log, self.sources, self.epoch)
        self.epoch += 1
        self.items = {(r.source_id, r.guid.rsplit(":", 1)[1]): r for r in self.store.table("feed_items").collect()}
        self.pending = {(r.source_id, r.guid.rsplit(":", 1)[1]): r.attempts for r in self.store.table("pending").collect()}

    def of(self, source):
        return {k[1] for k in self.items if k[0] == source}


def archive(*numbers):
    return "".join(f'<a href="/chapters/{n}/one-piece-chapter-{n}"><div>One Piece Chapter {n}</div><div>Title {n}</div></a>' for n in numbers)


def films(*slugs):
    return "".join(f'<article class="type-films"><h2 class="entry-title"><a href="https://visionario.movie/films/{s}/">Film {s}</a></h2></article>' for s in slugs)


def film(badge="Prima visione", opening="dal 15 Ott 2026", hall="Visionario"):
    return f'<div class="primaVisione">{badge}</div><p class="inizio">{opening}</p><span class="innerInfo">{hall}</span>'


def programme(*ids):
    return "".join(f'<a href="https://www.cine-cittafiera.com/scheda-film/?id_pro={i}">Film {i} <i class="properties">2D</i></a>' for i in ids)


def screening(day, director="R. Rossi"):
    return f'<p><strong>Regista:</strong> {director}</p><p><strong>Durata:</strong> 99 min</p><a href="/x?d={day}%2021:00">ore</a><a href="/x?d=2030-01-01">ore</a>'


def releases(*rows):
    parts = []
    for kind, *x in rows:
        if kind == "named":
            parts.append(f"<p><strong>{x[0]}</strong> <em>{x[1]}</em></p>")
        else:
            parts.append({"album": f'<iframe src="https://bandcamp.com/EmbeddedPlayer/v=2/album={x[0]}/"></iframe>', "track": f'<iframe src="https://bandcamp.com/EmbeddedPlayer/v=2/track={x[0]}/"></iframe>', "video": f'<iframe src="https://www.youtube.com/embed/{x[0]}"></iframe>'}[kind])
    return json.dumps({"ID": 395, "content": "".join(parts)})


def player(album=None, artist=None, title=None, tracks=()):
    data = {"album_id": album, "artist": artist, "album_title": title, "tracks": [{"id": i, "title": t, "artist": a} for i, t, a in tracks]}
    return f"<html data-player-data='{json.dumps(data)}'></html>"


BANDCAMP = "acloserlisten:bandcamp:"


def test_each_source_by_its_own_policy(spark, tmp_path):
    video = lambda title, author: json.dumps({"title": title, "author_name": author})
    site = Site(spark, {
        "citta-fiera:film:1": screening("2024-10-15"), "citta-fiera:film:2": screening("2024-10-17"), "citta-fiera:film:3": screening("2024-11-30"),
        f"{BANDCAMP}album:77": player(77, "Ann", "Moss"), f"{BANDCAMP}track:5": player(None, "Bo", None, [(5, "Song", "")]), f"{BANDCAMP}track:9": player(88, "Cy", "Sea", [(9, "Wave", "Cy")]), "acloserlisten:youtube:abcdefghijk": video("Dee - Sun", "Dee - Topic"),
        f"{BANDCAMP}album:1": player(1, "", ""), f"{BANDCAMP}album:2": player(3, "X", "Y"),
    })
    feed = Feed(spark, tmp_path, ["one-piece", "visionario", "citta-fiera", "acloserlisten"], site)
    held = lambda: {r.guid[-1]: str(r.day) for r in feed.store.table("held").collect()}
    title = lambda s, k: feed.items[s, k].title

    feed.poll(one_piece=archive(1100, 1099), visionario=films("old", "older"), citta_fiera=programme(1, 2, 3, 4), acloserlisten=releases(("named", "Ann", "Moss"), ("track", 5), ("track", 9), ("video", "abcdefghijk")))
    assert feed.of("one-piece") == {"1100"}  # the newest alone
    assert feed.of("visionario") == set()  # silent
    assert feed.of("citta-fiera") == {"1"} and feed.items["citta-fiera", "1"].description == "15 Ott 2024, R. Rossi, 99 min" and held() == {"2": "2024-10-17", "3": "2024-11-30"}
    assert {title("acloserlisten", k) for k in feed.of("acloserlisten")} == {"Ann — Moss", "Bo — Song", "Cy — Sea", "Dee — Sun"}  # all, under their own names
    assert not any("visionario" in guid or "one-piece" in guid for _, guid, _ in site.asked) and feed.pending == {("citta-fiera", "4"): 1}

    site.pages |= {"visionario:film:new": film(), "visionario:film:gala": film("Evento", ""), "visionario:film:odd": film("festival"), "citta-fiera:film:3": screening("2024-11-29")}
    begun = len(site.asked)
    feed.poll(one_piece=archive(1101, 1100, 1050), visionario=films("new", "gala", "later", "odd", "old"), citta_fiera=programme(1, 2, 3), acloserlisten=releases(("album", 77), ("track", 9), ("album", 88), ("track", 5), ("album", 1), ("album", 2), ("named", "Flo", "Day")))
    assert feed.of("one-piece") == {"1100", "1101"}  # an old one that comes back is no release
    assert feed.of("visionario") == {"new"} and feed.items["visionario", "new"].description == "dal 15 Ott 2026, Visionario"
    assert feed.of("citta-fiera") == {"1"} and held() == {"2": "2024-10-17", "3": "2024-11-29"}  # a held film is read again
    # The named album is embedded now: booked, not announced again. A nameless player and one of another album are set aside.
    assert {title("acloserlisten", k) for k in feed.of("acloserlisten")} == {"Ann — Moss", "Bo — Song", "Cy — Sea", "Dee — Sun", "Flo — Day"}
    assert {g for _, g, _ in site.asked[begun:] if g.startswith("acloser")} == {f"{BANDCAMP}album:{k}" for k in (77, 1, 2)}
    assert feed.pending == {("visionario", "later"): 1, ("visionario", "odd"): 1, ("acloserlisten", "1"): 1, ("acloserlisten", "2"): 1}
    assert {(r.epoch, r.guid.rsplit(":", 1)[1], r.stage, r.reason) for r in feed.store.table("rejects").collect()} == {(0, "4", "identity", "no readable page"), (1, "later", "identity", "no readable page"), (1, "odd", "identity", "no recognised badge"), (1, "1", "metadata", "no title"), (1, "2", "identity", "another album")}

    before = feed.items
    site.pages |= {"visionario:film:later": (429, None), f"{BANDCAMP}album:1": player(1, "Gil", "Ice"), f"{BANDCAMP}album:2": player(2, "Flo", "Day")}
    feed.poll(visionario=films("later", "next"), acloserlisten=releases(("album", 2), ("album", 1), ("named", "Gil", "Ice")))
    assert feed.of("visionario") == {"new"} and feed.pending == {("visionario", "later"): 1, ("visionario", "odd"): 1}  # a throttled page fails its source's poll
    assert {title("acloserlisten", k) for k in feed.of("acloserlisten")} - {r.title for r in before.values()} == {"Gil — Ice"}

    site.pages["visionario:film:later"] = film(opening="dal 1 Nov 2026")
    feed.poll(one_piece=archive(1104, 1102), visionario=films("later", "new", "gala", "old"), citta_fiera=programme(2, 4))
    assert feed.of("one-piece") == {"1100", "1101", "1102", "1104"}
    assert feed.of("visionario") == {"new", "later"} and feed.items["visionario", "later"].pub_date == at(3)  # unread before, announced once, now
    assert feed.of("citta-fiera") == {"1", "2"} and held() == {}  # what left the page is forgotten
    assert feed.pending == {("citta-fiera", "4"): 1} and {r.track: r.guid for r in feed.store.table("tracks").collect()} == {f"{BANDCAMP}track:5": f"{BANDCAMP}track:5", f"{BANDCAMP}track:9": f"{BANDCAMP}album:88"}
    assert {k: r.pub_date for k, r in feed.items.items() if k in before} == {k: r.pub_date for k, r in before.items()}


def epochs_of(seed, n=6):
    draw = random.Random(seed)
    return [(s, e, i, f"x:{g}", 1, 0) for s in ("s", "t", "u") for e in range(n) for i, g in enumerate(draw.sample(range(1, 30), draw.choice([0, 2, 6, 9])))]


def test_replay_is_the_closed_form(spark, tmp_path):
    rows, n = epochs_of(3, 4), 4
    policies = spark.createDataFrame([("s", None), ("t", None), ("u", "numbers")], "source_id string, policy string")
    one, whole = Store(spark, f"file://{tmp_path}/one"), Store(spark, f"file://{tmp_path}/whole")
    for e in range(n):
        assert announcements.step(one, observed(spark, [r for r in rows if r[1] == e]), e, policies)
    assert announcements.step(whole, observed(spark, rows), 0, policies)
    both = observed(spark, rows)
    numbered = announce.announce_numbers(both.where("source_id = 'u'").withColumn("number", F.substring_index("guid", ":", -1).cast("bigint"))).withColumn("guid", F.concat(F.lit("x:"), "number"))
    closed = announce.announce_once(both.where("source_id <> 'u'")).select("source_id", "guid", "epoch").union(numbered.select("source_id", "guid", "epoch"))
    dates = {(r.source_id, r.guid): r.pub_date for r in both.join(closed, ["source_id", "guid", "epoch"]).collect()}
    for store in (one, whole):
        assert {(r.source_id, r.guid): r.pub_date for r in store.table("feed_items").collect()} == dates
    assert not announcements.step(one, both, n - 1, policies)  # committed before


def test_several_polls_at_once_are_the_polls_one_by_one(spark, tmp_path):
    """Films and releases of many epochs in one batch, with pages that are there at some of them."""
    draw = random.Random(9)
    film_polls = [draw.sample(range(8), 4) for _ in range(3)]
    song_polls = [[draw.choice([("album", 1 + draw.randrange(4)), ("named", "A", f"T{draw.randrange(4)}"), ("track", 50 + draw.randrange(4))]) for _ in range(5)] for _ in range(3)]
    log = [main_page("visionario", e, films(*[f"f{i}" for i in p])) for e, p in enumerate(film_polls)] + [main_page("acloserlisten", e, releases(*p)) for e, p in enumerate(song_polls)]
    own = []
    for e in range(3):
        for i in range(8):
            if draw.random() < 0.5:
                own.append(("visionario", e, f"visionario:film:f{i}", "u", 200, None, film(draw.choice(["Prima visione", "Evento"])), at(e)))
        for i in range(4):
            if draw.random() < 0.6:
                own.append(("acloserlisten", e, f"{BANDCAMP}album:{1 + i}", "u", 200, None, player(1 + i, "A", f"T{i}"), at(e)))
            if draw.random() < 0.6:
                own.append(("acloserlisten", e, f"{BANDCAMP}track:{50 + i}", "u", 200, None, player(1 + i if i % 2 else None, "A", f"T{i}", [(50 + i, f"S{i}", "A")]), at(e)))
    sources = registry.sources(spark).where("id in ('visionario', 'acloserlisten')")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    one, whole = Store(spark, f"file://{tmp_path}/one"), Store(spark, f"file://{tmp_path}/whole")
    for e in range(3):
        polls.poll(one, frame([r for r in log if r[1] == e], PAGE_LOG), sources, e, item_log=frame([r for r in own if r[1] == e], ITEM_LOG))
    polls.poll(whole, frame(log, PAGE_LOG), sources, 0, item_log=frame(own, ITEM_LOG))
    for table in ("feed_items", "announced", "aliases", "tracks", "pending", "rejects", "announce_state"):
        assert Counter(map(str, one.table(table).collect())) == Counter(map(str, whole.table(table).collect())), table
    assert one.table("feed_items").count() >= 3


def test_decided_pages_are_the_fold():
    """Without untitled items a page is decided as by the fold over the same state."""
    draw = random.Random(4)
    for _ in range(200):
        state, items = {"announced": set(), "names": {}}, []
        for k in draw.sample(range(6), 3):
            state["announced"] |= {f"acloserlisten:bandcamp:album:{k}"} if draw.random() < 0.5 else {f"acloserlisten:named:a:{k}"}
        state["names"] = {f"acloserlisten:bandcamp:album:{k}": [f"a:{k}", f"a:{k + 1}"] for k in range(6)}
        for _ in range(draw.randrange(1, 7)):
            k = draw.randrange(6)
            items.append(draw.choice([{"guid": f"acloserlisten:bandcamp:album:{k}", "names": state["names"][f"acloserlisten:bandcamp:album:{k}"]}, {"guid": f"acloserlisten:named:a:{k}", "names": [f"a:{k}"]}, {"guid": f"acloserlisten:youtube:{k}", "names": []}]))
        items = list({i["guid"]: i for i in items}.values())
        booked = set(state["announced"])
        taken = {n for g in booked for n in (state["names"][g] if ":album:" in g else [g.partition(":named:")[2]])}
        page = pd.DataFrame([("s", 0, o, i["guid"], i["names"], i["guid"] in booked, any(n in taken for n in i["names"]), True) for o, i in enumerate(items)], columns=["source_id", "epoch", "ord", "guid", "names", "booked", "taken", "titled"])
        got = announcements.decide_page(page)
        assert set(got.guid[got.outcome == "publish"]) == {i["guid"] for i in flows.decide_releases(state, items)}
        assert set(got.guid) == {i["guid"] for i in items} - booked
