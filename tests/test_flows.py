import datetime as dt
import json

from pyspark.sql import functions as F

from feltloom.plans import flows
from feltloom.sources import html, pages


def log(spark, body, source="s", epoch=0):
    return spark.createDataFrame([(source, epoch, body)], "source_id string, epoch bigint, body string")


def items(frame):
    return [(r.guid, r.title, r.link) for r in frame.orderBy("ord").collect()]


def test_nodes_and_selections(spark):
    page = '<html><body><ul class="a b"><li>one<li>two <a href="/x?y=1&amp;z">link <b>bold</b></a></ul><p>p1<p class="c">p2<br>end<div>d</div></body>'
    frame = spark.createDataFrame([(1, page), (2, None)], "id int, body string")
    nodes = html.dom_nodes(frame, "body", "id")
    assert [r.tag for r in html.elements(nodes).orderBy("pos").collect()] == ["html", "body", "ul", "li", "li", "a", "b", "p", "p", "br", "div"]
    assert html.elements(nodes, cls="b").select("tag").first()[0] == "ul" and html.elements(nodes, cls="z").count() == 0
    lists = html.children(nodes, html.elements(nodes, "ul"), "id", "li")
    assert lists.count() == 2
    assert [(r.href, r.content) for r in html.links(nodes, "id").collect()] == [("/x?y=1&z", "link bold")]
    texts = html.subtree_text(nodes, html.elements(nodes, "p"), "id", without=html.elements(nodes, cls="c"))
    assert [r.content for r in texts.orderBy("of").collect()] == ["p1", ""]
    html.register(spark)
    frame.createOrReplaceTempView("pages_in")
    assert spark.sql("SELECT count(*) FROM pages_in, LATERAL parse_html(body) WHERE tag = 'li'").first()[0] == 2


def test_catalog(spark):
    thread = {"no": 7, "sub": "/ptg/ - Private Trackers General", "com": "Intro<br>The &quot;Best&quot; Edition<br>&gt;quote", "time": 1704067200, "resto": 0, "replies": 150, "images": 1}
    body = json.dumps([{"page": 1, "threads": [thread, thread | {"no": 8, "sub": "/PTG/ special", "com": "x", "replies": -1}, thread | {"no": 9, "resto": 5}, thread | {"no": 10, "sub": "other"}]}, {"page": 2, "threads": [thread | {"no": 11, "com": ""}]}])
    got = flows.catalog(log(spark, body), "ptg").orderBy("ord").collect()
    assert [(r.guid, r.title, r.link, r.replies) for r in got] == [("ptg:7", 'Private Trackers General — The "Best" Edition', "https://boards.4chan.org/g/thread/7/", 150), ("ptg:8", "special", "https://boards.4chan.org/g/thread/8/", 0)]
    assert got[0].description == 'Intro\nThe "Best" Edition\n>quote' and got[0].pub_date == dt.datetime(2024, 1, 1) and json.loads(got[0].metadata)["no"] == 7
    again = flows.thread_items(spark.createDataFrame([("s", 0, 0, got[0].metadata)], "source_id string, epoch bigint, ord int, saved string").withColumn("t", F.from_json("saved", "no bigint, sub string, com string, time bigint, resto bigint, replies int, images int")), "ptg").first()
    assert (again.guid, again.title, again.description) == (got[0].guid, got[0].title, got[0].description)


def test_chapters(spark):
    card = '<a href="{h}"><div>{a}</div><div> {b} </div></a>'
    body = "".join(card.format(h=h, a=a, b=b) for h, a, b in [
        ("/chapters/10/one-piece-chapter-1101", "One Piece Chapter 1101", "Dawn"), ("https://tcbonepiecechapters.com/chapters/9/one-piece-chapter-1100-review-2", "Chapter 1100", "CHAPTER 1100"),
        ("/chapters/8/one-piece-chapter-1101", "Chapter 1101", "again"), ("/chapters/7/other-chapter-3", "Chapter 3", ""), ("/chapters/6/one-piece-chapter-1099", "Chapter 12", "wrong"), ("https://elsewhere.com/chapters/5/one-piece-chapter-1", "Chapter 1", ""),
    ])
    assert items(flows.chapters(log(spark, body))) == [
        ("one-piece:chapter:1101", "One Piece Chapter 1101 — Dawn", "https://tcbonepiecechapters.com/chapters/10/one-piece-chapter-1101"),
        ("one-piece:chapter:1100", "Chapter 1100", "https://tcbonepiecechapters.com/chapters/9/one-piece-chapter-1100-review-2"),
    ]


def test_essays(spark):
    inner = '<h2>Intro</h2><a href="/essays/no/">no</a><h2> All essays </h2><ul><li><a href="/essays/one/"> One </a></li><li><a href="/essays/one/">Dup</a></li><li><a href="/essays/issues/">I</a></li><li><a href="/about/">x</a></li></ul><h3>Next</h3><a href="/essays/late/">late</a>'
    assert items(flows.essays(log(spark, f"<body><a href='/essays/out/'>o</a><noscript>{inner}</noscript></body>"))) == [("coached:essay:one", "One", "https://coached.com/essays/one/")]
    own = spark.createDataFrame([("s", "g", '<meta property="article:published_time" content="2024-05-06">'), ("s", "h", '<meta property="article:published_time" content="2024-05-06T01:02:03+02:00">'), ("s", "i", "<p>")], "source_id string, guid string, body string")
    assert {r.guid: r.page_date for r in flows.essay_dates(own).collect()} == {"g": dt.datetime(2024, 5, 6), "h": dt.datetime(2024, 5, 5, 23, 2, 3)}


def test_matches(spark):
    head = "<tr><th>Date</th><th>Match</th><th>Promotion</th><th>Event</th><th>Rating</th><th>Notes</th></tr>"
    body = f"""<h2>2010s</h2><table>{head}<tr><td>x</td><td>m</td><td>p</td><td>e</td><td>5</td><td></td></tr></table><h2>2020s<sup>1</sup></h2><table>{head}
    <tr><td rowspan="2">January 4, 2023</td><td>A vs. B<sup class="reference">[1]</sup></td><td>NJ</td><td rowspan=2>Dome</td><td>6.25</td><td>n</td></tr>
    <tr><td>C ( D )</td><td>NJ</td><td>5 stars</td></tr><tr><td>soon</td><td></td><td>p</td><td>e</td><td>5</td><td></td></tr><tr><td>Unknown</td><td>E</td><td></td><td>F</td><td>5</td><td></td></tr></table>"""
    got = flows.matches(log(spark, body)).orderBy("ord").collect()
    assert [(r.guid, r.title, r.description, r.pub_date) for r in got] == [
        ("meltzer:2023-01-04:a-vs-b:dome", "A vs. B — Dome", "NJ · 6.25 stars · n", dt.datetime(2023, 1, 4)),
        ("meltzer:2023-01-04:c-d:dome", "C (D) — Dome", "NJ · 5 stars", dt.datetime(2023, 1, 4)),
        ("meltzer:unknown:e:f", "E — F", "5 stars", None),
    ]


def test_recommendations(spark):
    torrent = {"id": "t1", "releaseGroup": "G", "isBest": True, "tags": ["x"], "dualAudio": True, "url": "u", "tracker": "N"}
    entry = {"id": "e", "alID": 5, "notes": "a\r\nb", "theoreticalBest": "", "incomplete": True, "comparison": "c2,c1,,c1", "trs": ["t1", "t2"], "expand": {"trs": [torrent, torrent | {"id": "t2", "releaseGroup": "H", "isBest": False, "dualAudio": False, "tags": []}]}}
    body = json.dumps({"page": 1, "totalPages": 1, "totalItems": 1, "items": [entry]})
    got = flows.recommendations(log(spark, body)).first()
    made = json.loads(got.metadata)
    assert (got.guid, got.title, got.link) == ("5", "AniList 5", "https://releases.moe/5/")
    assert made["best"] == ["G"] and made["alt"] == ["H"] and made["notes"] == ["a", "b"] and made["comparisons"] == ["c1", "c2"] and made["dual_audio"] == ["G"] and made["incomplete"] == ["Yes"] and made["tags"] == ["G: x"]
    assert made["releases"] == ["Alt: H [t2] N u", "Best: G [t1] N u"]
    for bad in (entry | {"trs": ["t1"]}, entry | {"trs": None}, entry | {"alID": 0}, entry | {"expand": {"trs": [torrent | {"isBest": None}]}, "trs": ["t1"]}):
        page = flows.recommendation_pages(log(spark, json.dumps({"page": 1, "totalPages": 1, "totalItems": 1, "items": [bad]}))).first()
        assert not page.sound
    facts = spark.createDataFrame([(5, "", "Pref", "https://c/i.png", 0), (5, "Later", "x", "", 1)], "alID int, title_english string, title_userPreferred string, coverImage_medium string, ord int")
    named = flows.with_anime_titles(flows.recommendations(log(spark, body)), facts).first()
    assert named.title == "Pref" and named.description == '<img src="https://c/i.png" alt="Pref" width="100">'


def test_stack(spark):
    def page(number="82158", declared=2, cards=("1", "2"), extra=""):
        made = "".join(f'<div class="seasonal-anime x"><a class="link-title" href="/anime/{i}/t"> T{i} </a><div class="intro">Note {i}<br><br>see <a href="https://k/">k</a></div></div>' for i in cards)
        return f'<head><meta property="og:url" content="https://myanimelist.net/stacks/{number}"><meta property="og:description" content="1 Entries of {declared} Entries"></head><div class="content-left stacks-detail">{extra}<div class="list-anime-list">{made}</div></div>'

    got = flows.stack(log(spark, page()), "82158").orderBy("ord").collect()
    assert [(r.guid, r.title, r.link) for r in got] == [("1", "T1", "https://myanimelist.net/anime/1"), ("2", "T2", "https://myanimelist.net/anime/2")]
    assert json.loads(got[0].metadata) == {"version": 1, "notes": ["Note 1", "", "see k (https://k/)"]}
    for bad in (page("38814"), page(declared=3), page(cards=("1", "1")), page(extra='<a rel="next">n</a>'), page().replace("intro", "outro")):
        assert flows.stack(log(spark, bad), "82158").count() == 0
    assert flows.stack_entries(log(spark, page(declared=0, cards=())), "82158").first().ok


def test_films(spark):
    card = '<article class="post type-films"><h2 class="entry-title"><a href="{h}"> {t} </a></h2><a href="/films/other/">o</a></article>'
    body = card.format(h="/films/alpha/", t="Alpha  Film") + card.format(h="https://visionario.movie/films/beta-2/", t="Beta") + card.format(h="/films/alpha/", t="Again")
    assert items(flows.films(log(spark, body))) == [("visionario:film:alpha", "Alpha Film", "https://visionario.movie/films/alpha/"), ("visionario:film:beta-2", "Beta", "https://visionario.movie/films/beta-2/")]
    note = lambda badge, opening="dal 15 Ott 2026", hall="Cinema Centrale": f'<span class="primaVisione">{badge}</span><div class="inizio">{opening}</div><div class="innerInfo">{hall}</div><div class="innerInfo">Visionario</div><div class="innerInfo">Bar</div>'
    own = [("s", "a", note("Prima Visione")), ("s", "b", note("Evento speciale", "")), ("s", "c", note("Boh")), ("s", "d", note("Anteprima", "")), ("s", "e", note("Anteprima", "presto"))]
    got = {r.guid: r for r in flows.film_notes(spark.createDataFrame(own, "source_id string, guid string, body string")).collect()}
    assert (got["a"].kind, got["a"].opening, got["a"].halls, got["a"].reason) == ("release", "dal 15 Ott 2026", ["Centrale", "Visionario"], None)
    assert got["b"].kind == "event" and got["b"].reason is None and got["c"].reason == "no recognised badge" and got["d"].reason == "no opening date" and got["e"].reason == "unrecognised opening"
    frame = spark.createDataFrame([("dal 1 Gen 2026", ["Centrale"])], "o string, h array<string>")
    assert frame.select(flows.film_description(F.col("o"), F.col("h"))).first()[0] == "dal 1 Gen 2026, Centrale"


def test_screenings(spark):
    body = '<a href="/scheda-film/?id_pro=12"><span class="properties">3D</span> Film  A</a><a href="https://www.cine-cittafiera.com/scheda-film?id_pro=13">Scopri di più</a><a href="/scheda-film/?id_pro=14">B</a><a href="/scheda-film/?id_pro=12">dup</a><a href="/scheda-film/?id_pro=x">C</a><a href="https://evil.com/scheda-film/?id_pro=15">D</a>'
    assert items(flows.screenings(log(spark, body))) == [("citta-fiera:film:12", "Film A", "https://www.cine-cittafiera.com/scheda-film/?id_pro=12"), ("citta-fiera:film:14", "B", "https://www.cine-cittafiera.com/scheda-film/?id_pro=14")]
    own = [("s", "a", '<a href="?d=2026-10-20+21:00">x</a><a href="?d=2026-10-05">y</a><p><strong>Regista:</strong> Some One</p><p><strong>Durata:</strong> 90 min</p>'), ("s", "b", '<a href="?d=never">x</a>')]
    got = {r.guid: r for r in flows.screening_notes(spark.createDataFrame(own, "source_id string, guid string, body string")).collect()}
    assert (str(got["a"].first_day), got["a"].director, got["a"].duration) == ("2026-10-05", "Some One", "90 min") and got["b"].first_day is None
    frame = spark.createDataFrame([(dt.date(2026, 10, 5), "D", "")], "f date, d string, l string")
    assert frame.select(flows.screening_description(F.col("f"), F.col("d"), F.col("l"))).first()[0] == "5 Ott 2026, D"


def test_releases(spark):
    content = """<p><strong>Ambient<br/></strong></p><p><strong>Artist One,</strong> and <em>First: Title.</em> then <em>not this</em></p><iframe src="//bandcamp.com/EmbeddedPlayer/v=2/album=42/size=large"></iframe>
    <p><strong>Rock<br></strong><strong>Two</strong><em>Second</em></p><iframe src="https://bandcamp.com/EmbeddedPlayer/track=7/album=43"></iframe><iframe src="https://bandcamp.com/EmbeddedPlayer/v=2/track=9/"></iframe>
    <iframe src="https://www.youtube.com/embed/abcdefghijk?x=1"></iframe><iframe src="https://evil.com/EmbeddedPlayer/album=1"></iframe><iframe src="https://bandcamp.com/EmbeddedPlayer/album=x"></iframe>"""
    got = flows.releases(log(spark, json.dumps({"ID": 395, "content": content}))).orderBy("ord").collect()
    assert [(r.guid.removeprefix("acloserlisten:"), r.title, r.description) for r in got] == [
        ("named:artistone:firsttitle", "Artist One — First: Title", "Genre: Ambient"), ("bandcamp:album:42", "", "Genre: Ambient"), ("named:two:second", "Two — Second", "Genre: Rock"),
        ("bandcamp:album:43", "", "Genre: Rock"), ("bandcamp:track:9", "", "Genre: Rock"), ("youtube:abcdefghijk", "", "Genre: Rock"),
    ]
    assert flows.releases(log(spark, json.dumps({"ID": 1, "content": content}))).count() == 0
    data = lambda d: f"<div data-player-data='{json.dumps(d)}'></div>"
    own = spark.createDataFrame([("s", got[1].guid, data({"album_id": 42, "artist": "Artist One", "album_title": "First Title (Deluxe)", "tracks": []})), ("s", got[3].guid, data({"album_id": 44, "artist": "x", "album_title": "y", "tracks": []})), ("s", got[4].guid, data({"album_id": None, "artist": "", "tracks": [{"id": 9, "artist": "T A", "title": "T T"}]}))], "source_id string, guid string, body string")
    solved = {r.guid.removeprefix("acloserlisten:"): r for r in flows.resolve_players(flows.releases(log(spark, json.dumps({"ID": 395, "content": content}))), flows.players(own)).collect()}
    assert solved["bandcamp:album:42"].title == "Artist One — First Title (Deluxe)" and solved["bandcamp:album:42"].names == ["artistone:firsttitledeluxe", "artistone:firsttitle"]
    assert solved["bandcamp:album:43"].reason == "another album" and solved["bandcamp:track:9"].title == "T A — T T" and solved["named:two:second"].reason is None
    urls = spark.createDataFrame([("album", "4"), ("youtube", "abcdefghijk"), ("named", "a:b")], "k string, i string").select(flows.player_url(F.col("k"), F.col("i")).alias("u")).collect()
    assert [r.u for r in urls] == ["https://bandcamp.com/EmbeddedPlayer/v=2/album=4/size=large/artwork=small/", "https://www.youtube.com/oembed?format=json&url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3Dabcdefghijk", ""]
    titles = spark.createDataFrame([("Some Band - Song", "SomeBand - Topic"), ("Song", "Band"), ("Other — X", "Band")], "t string, a string").select(flows.video_title(F.col("t"), F.col("a")).alias("v")).collect()
    assert [r.v for r in titles] == ["Some Band — Song", "Band — Song", "Band — Other — X"]


def test_release_decisions():
    album, named, track = "acloserlisten:bandcamp:album:1", "acloserlisten:named:a:t", "acloserlisten:bandcamp:track:9"
    state = {"announced": set(), "names": {}}
    first = flows.decide_releases(state, [{"guid": named, "names": ["a:t"]}, {"guid": album, "names": ["a:tep", "a:t"]}, {"guid": track, "names": []}])
    assert [i["guid"] for i in first] == [album, track] and state["announced"] == {album, named, track}  # the suppressed one is booked too
    again = flows.decide_releases(state, [{"guid": "acloserlisten:named:a:tep", "names": []}, {"guid": "acloserlisten:bandcamp:album:2", "names": ["b:u"]}, {"guid": album, "names": []}])
    assert [i["guid"] for i in again] == ["acloserlisten:bandcamp:album:2"]


def test_page_log(spark):
    store = {"https://a/1": {"status": 200, "etag": "e", "body": "x"}, "https://a/2": {"status": 429, "retry_after": "30"}, "https://b/": {"status": 304}}
    requests = [{"source_id": "s", "epoch": i, "url": u, "at": "2024-01-01T00:00:00"} for i, u in enumerate(store)]
    found = pages.classified(pages.fetch_pages(spark, lambda url, etag, modified: store[url], requests))
    assert {r.url: (r.outcome, r.wait_s) for r in found.collect()} == {"https://a/1": ("modified", None), "https://a/2": ("throttled", 30), "https://b/": ("unchanged", None)}
    ok, rejects = pages.bounded(found)
    assert ok.count() == 3 and rejects.count() == 0
    ready, missing = pages.item_pages(spark.createDataFrame([("s", 0, "g", "https://a/1"), ("s", 0, "h", "https://a/2")], "source_id string, epoch bigint, guid string, link string"), found)
    assert [r.page_body for r in ready.collect()] == ["x"] and [r.guid for r in missing.collect()] == ["h"]


def test_release_names_have_one_holder():
    """Against the rule itself: who is published shares no name with what was booked or published before; who is not, does."""
    import random

    draw = random.Random(3)
    state = {"announced": set(), "names": {}}
    for _ in range(200):
        booked, items = set(state["announced"]), []
        for _ in range(draw.randrange(1, 9)):
            name = f"n{draw.randrange(30)}"
            kind = draw.choice(["named", "album", "track"])
            items.append({"guid": f"s:named:{name}" if kind == "named" else f"s:{kind}:{draw.randrange(60)}", "names": draw.sample([f"n{i}" for i in range(30)], draw.randrange(4)) if kind == "album" else None})
        shown = [i["guid"] for i in flows.decide_releases(state, items)]
        of = lambda g: {g.split(":named:")[1]} if ":named:" in g else set(state["names"].get(g, []))
        held = set().union(*map(of, booked))
        played = set().union(*(of(i["guid"]) for i in items if ":album:" in i["guid"]))
        page = list(dict.fromkeys(i["guid"] for i in items))
        assert shown == [g for g in page if g in set(shown)] and state["announced"] == booked | set(page)
        for g in page:
            before = held.union(*(of(x) for x in shown if page.index(x) < page.index(g)))
            assert (g in shown) == (g not in booked and not of(g) & before and not (":named:" in g and of(g) & played))
        if draw.random() < 0.05:
            state = {"announced": set(), "names": {}}


def test_nothing_to_decide():
    state = {"announced": set(), "names": {}}
    assert flows.decide_releases(state, []) == [] and state == {"announced": set(), "names": {}}
