"""The registered extractors: pages (source_id, epoch, body) to observations in page order.

Each is a function of DataFrames; what needs a page's tree reads it once, in one Arrow pass, and the rest
are expressions. A page that breaks an extractor's rules yields no rows and so no successful epoch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltloom.functions import arrays, dates, text, urls
from feltloom.functions.fragments import break_text, tree_text
from feltloom.operators.projection import keep_first
from feltloom.sources import html

KEYS = ("source_id", "epoch")
ITEM = ("source_id", "guid")

# Hosts, paths and patterns of the registered sites.
CHAPTER_HOST, CHAPTER_PATH = "tcbonepiecechapters.com", r"^/chapters/\d+/one-piece-chapter-(\d+)(?:-review-\d+)?$"
FILM_HOST, FILM_PATH = "visionario.movie", r"^/films/([a-z0-9-]+)/$"
OPENING = r"(?i)^dal\s+\d{1,2}\s+(gen|feb|mar|apr|mag|giu|lug|ago|set|ott|nov|dic)\s+\d{4}$"
ESSAY_HOST, ESSAY_PATH, ESSAY_HEADING = "coached.com", r"^/essays/([a-z0-9-]+)/$", "All essays"
CINEMA_HOST, MORE_LINKS = "www.cine-cittafiera.com", ["scopri di più", "scopri di piu"]
MATCH_PAGE, DECADE, MATCH_COLUMNS = "https://en.wikipedia.org/wiki/List_of_professional_wrestling_matches_rated_5_or_more_stars_by_Dave_Meltzer", "2020s", ["date", "match", "promotion", "event", "rating"]
BOARDS = {"ptg": ("g", "Private Trackers General"), "film": ("tv", "Arthouse & Classics")}
RELEASES_LINK, STACK_HOST = "https://releases.moe/", "myanimelist.net"
RECOMMENDATIONS, RECOMMENDATION_PAGE = "https://acloserlisten.com/recommendations/", 395
PLAYER_HOSTS, VIDEO_HOSTS = ["bandcamp.com", "www.bandcamp.com"], ["youtube.com", "www.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com"]
VIDEO_ID, PLAYER_SUFFIX = r"^[A-Za-z0-9_-]{11}$", "/size=large/artwork=small/"


def _observations(rows: DataFrame, **columns: Column) -> DataFrame:
    """The columns of observations; those not given are empty."""
    given = {"title": F.lit(""), "link": F.lit(""), "description": F.lit(""), "metadata": F.lit(""), "pub_date": F.lit(None).cast("timestamp"), "replies": F.lit(0)} | columns
    return rows.select("source_id", "epoch", F.col("ord").cast("int").alias("ord"), *[given[c].alias(c) for c in ("guid", "title", "link", "description", "metadata", "pub_date", "replies")])


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row, however often it is read: conditions on what is exploded stay above it."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _first_of(rows: DataFrame) -> DataFrame:
    return keep_first(rows, ["source_id", "epoch", "guid"], "ord")


def catalog(pages: DataFrame, general: str) -> DataFrame:
    """Opening posts of a board's general, with their input saved for a rebuild."""
    board, name = BOARDS[general]
    thread = "struct<no:bigint,sub:string,com:string,time:bigint,resto:bigint,replies:int,images:int>"
    parsed = pages.select(*KEYS, F.posexplode(F.from_json("body", f"array<struct<threads:array<{thread}>>>")).alias("p", "page"))
    threads = parsed.select(*KEYS, "p", F.posexplode("page.threads").alias("i", "t")).where(F.lower("t.sub").contains(f"/{general}/"))
    return thread_items(threads.select(*KEYS, (F.col("p") * 10_000 + F.col("i")).alias("ord"), "t", F.to_json("t").alias("saved")), general)


def thread_items(threads: DataFrame, general: str) -> DataFrame:
    """Items of valid threads (column t); a rebuild runs the same over saved inputs."""
    board, name = BOARDS[general]
    valid = threads.where("t.no > 0 and coalesce(t.resto, 0) = 0 and t.sub <> '' and t.com <> '' and t.time > 0")
    marker, number = f"/{general}/", F.col("t.no").cast("string")
    said = _once(valid, "said", text.tidy_text(break_text(F.col("t.com")))).where("said <> ''")
    said = _once(_once(said, "subject", text.strip_marker(F.col("t.sub"), marker)), "edition", text.title_line("said", name, marker))
    subject, edition = F.col("subject"), F.col("edition")
    title = F.when((subject != "") & (text.fold_name(subject) != text.fold_name(F.lit(name))), subject).when(edition == "", F.lit(name)).otherwise(F.concat(F.lit(f"{name} — "), edition))
    return _observations(
        said, guid=F.concat(F.lit(f"{general}:"), number), title=title, link=F.concat(F.lit(f"https://boards.4chan.org/{board}/thread/"), number, F.lit("/")), description=F.col("said"),
        metadata=F.col("saved"), pub_date=F.timestamp_seconds("t.time"), replies=F.greatest(F.coalesce(F.col("t.replies"), F.lit(0)), F.lit(0)),
    )


def _chapters(page: str | None) -> list[tuple]:
    """Place and address of each anchor that has divs for children, and what these say."""
    nodes, divs = html.tree(page, frozenset(("div",))), {}
    for n in nodes:
        if n[5] == "div" and n[1] >= 0 and nodes[n[1]][5] == "a":
            divs.setdefault(n[1], []).append(n[7])
    return [(pos, nodes[pos][6].get("href", ""), said) for pos, said in divs.items()]


def chapters(pages: DataFrame) -> DataFrame:
    """Chapter links whose heading names the link's number."""
    rows = html.page_rows(pages, "body", _chapters, "parent int, href string, divs array<string>", *KEYS)
    anchors = _once(rows.where(~F.trim("href").rlike("(?i)^http://")), "path", urls.site_path("href", [CHAPTER_HOST])).where("path is not null")
    # A cast that fails is an exception, which takes longer than all else here: what has no number is told before.
    linked = _once(anchors, "digits", F.regexp_extract("path", CHAPTER_PATH, 1)).where("digits <> ''")
    numbered = _once(linked, "number", F.col("digits").try_cast("int")).where("number > 0")
    said = _once(numbered, "texts", F.filter(F.transform("divs", lambda d: text.collapse_space(d)), lambda x: x != ""))
    named = F.transform("texts", lambda x: F.regexp_extract(x, r"(?i)\bchapter\s+0*(\d+)\b", 1) == F.col("number").cast("string"))
    placed = _once(said, "at", F.array_position(named, True).cast("int")).where("at > 0")
    found = placed.select(*KEYS, F.col("parent").alias("ord"), "number", "path", F.get("texts", F.col("at") - 1).alias("heading"), F.get("texts", F.col("at")).alias("subtitle"))
    number = F.col("number").cast("string")
    return _first_of(_observations(found, guid=F.concat(F.lit("one-piece:chapter:"), number), title=text.join_titles("heading", "subtitle"), link=F.concat(F.lit(f"https://{CHAPTER_HOST}"), F.col("path"))))


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _section(page: str | None) -> list[tuple]:
    """Place, address and text of the anchors between the first heading that says so and the next heading."""
    found, inside = [], False
    for n in html.tree(page, _HEADINGS | {"a"}):
        if n[5] in _HEADINGS:
            if inside:
                break
            inside = n[7].strip(" ") == ESSAY_HEADING
        elif inside and n[5] == "a":
            found.append((n[0], n[6].get("href", ""), n[7]))
    return found


def essays(pages: DataFrame) -> DataFrame:
    """Links of the first section headed so in each <noscript>, whose text is a page of its own."""
    rows = html.page_rows(_noscripts(pages), "text", _section, "pos int, href string, text string", *KEYS, "block")
    slug = F.regexp_extract(F.trim("href"), ESSAY_PATH, 1)
    found = _once(rows, "slug", slug).where((F.col("slug") != "") & (F.col("slug") != "issues") & (F.trim("text") != ""))
    found = found.withColumn("ord", F.col("block") * 100_000 + F.col("pos"))
    return _first_of(_observations(found, guid=F.concat(F.lit("coached:essay:"), F.col("slug")), title=F.btrim(F.col("text")), link=F.concat(F.lit(f"https://{ESSAY_HOST}/essays/"), F.col("slug"), F.lit("/"))))


def _noscripts(pages: DataFrame) -> DataFrame:
    """Contents of <noscript>, numbered: browsers with scripts read them as text."""
    found = F.regexp_extract_all("body", F.lit(r"(?is)<noscript[^>]*>(.*?)</noscript>"), F.lit(1))
    return pages.select(*KEYS, F.posexplode(found).alias("block", "text"))


def essay_dates(pages: DataFrame) -> DataFrame:
    """source_id, guid, page_date from items' own pages (column guid)."""
    nodes = html.dom_nodes(pages, "body", "source_id", "guid")
    first = html.first_element(html.elements(nodes, "meta").where(html.attribute("property") == "article:published_time"), "source_id", "guid")
    value = F.trim(html.attribute("content"))
    return first.select("source_id", "guid", dates.parse_first(value, "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("page_date")).where("page_date is not null")


_ROW = "heading string, n int, cells map<string,string>"


def _tables(page: str | None) -> list[tuple[str, int, dict]]:
    """(heading, row, {column: text}) of the tables outside tables, cells that span rows repeated below."""
    nodes = html.tree(page)
    skip = lambda n: n[5] == "sup" or n[6] and "class" in n[6] and "reference" in n[6]["class"].split()

    def words(n: list) -> str:
        out, i, last = [], n[0], n[2]
        if last == i + 1 and not skip(n):  # most cells hold one text
            out, i = [nodes[last][7] or ""], last + 1
        while i <= last:
            m = nodes[i]
            if m[4] == "text":
                out.append(m[7])
            elif skip(m):
                i = m[2]
            i += 1
        s = " ".join(" ".join(out).split())
        return s.replace(" ,", ",").replace("( ", "(").replace(" )", ")") if " ," in s or "( " in s or " )" in s else s

    found, heading, i = [], "", 0
    while i < len(nodes):
        n = nodes[i]
        if n[4] == "element" and n[5] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = words(n).lower()
        if n[5] != "table":
            i += 1
            continue
        rows = [m for m in nodes[n[0] : n[2] + 1] if m[5] == "tr"]

        def kids(row: tuple, tag: str) -> list[tuple]:
            out, at = [], row[0] + 1
            while at <= row[2]:  # from child to child
                if nodes[at][5] == tag:
                    out.append(nodes[at])
                at = nodes[at][2] + 1
            return out

        names = [words(c).lower() for c in kids(rows[0], "th")] if rows else []
        spans: dict[int, list] = {}
        for number, row in enumerate(rows[1:]):
            cells = iter(kids(row, "td"))
            first = next(cells, None)
            if first is None:
                continue
            queue, values = [first, *cells], {}
            for column, name in enumerate(names):
                if column in spans:
                    value = spans[column][0]
                    spans[column][1] -= 1
                    if spans[column][1] <= 0:
                        del spans[column]
                elif queue:
                    cell = queue.pop(0)
                    value = words(cell)
                    span = (cell[6] or {}).get("rowspan", "")
                    if span.strip().isdigit() and int(span) > 1:
                        spans[column] = [value, int(span) - 1]
                else:
                    value = ""
                if name:
                    values[name] = value
            found.append((heading, n[0] * 10_000 + number, values))
        i = n[2] + 1
    return found


def page_tables(pages: DataFrame) -> DataFrame:
    return html.page_rows(pages.select("source_id", F.col("epoch").cast("bigint").alias("epoch"), "body"), "body", _tables, _ROW, *KEYS)


def matches(pages: DataFrame) -> DataFrame:
    """Rows of the decade's tables that have all columns."""
    cell = lambda name: F.coalesce(F.element_at("cells", F.lit(name)), F.lit(""))
    whole = F.lit(True)
    for name in MATCH_COLUMNS:
        whole &= F.map_contains_key("cells", F.lit(name))
    rows = page_tables(pages).where(F.col("heading").startswith(DECADE) & whole & (cell("match") != "") & (cell("event") != ""))
    day = F.try_to_timestamp(cell("date"), F.lit("MMMM d, yyyy"))
    part = F.when(cell("date") == "", "no-date").otherwise(F.coalesce(F.date_format(day, "yyyy-MM-dd"), text.slug(cell("date"))))
    return _observations(
        rows.withColumnRenamed("n", "ord"), guid=F.concat_ws(":", F.lit("meltzer"), part, text.slug(cell("match")), text.slug(cell("event"))), title=F.concat(cell("match"), F.lit(" — "), cell("event")),
        link=F.lit(MATCH_PAGE), description=text.join_parts(cell("promotion"), text.stars(cell("rating")), cell("notes")), pub_date=day,
    )


_TORRENT = "struct<id:string,releaseGroup:string,isBest:boolean,tags:array<string>,dualAudio:boolean,url:string,tracker:string>"
_ENTRY = f"struct<id:string,alID:int,notes:string,theoreticalBest:string,incomplete:boolean,comparison:string,trs:array<string>,expand:struct<trs:array<{_TORRENT}>>>"
#: What is compared: nine sections.
SECTION_STRUCT = "struct<best:array<string>,alt:array<string>,unmuxed_best:array<string>,notes:array<string>,tags:array<string>,dual_audio:array<string>,incomplete:array<string>,comparisons:array<string>,releases:array<string>>"


def recommendation_pages(pages: DataFrame) -> DataFrame:
    """Page headers and whether every entry of the page is whole: what the pagination gate reads."""
    parsed = pages.select(*KEYS, F.from_json("body", f"page int, totalPages int, totalItems int, items array<{_ENTRY}>").alias("r"))

    def sound(e: Column) -> Column:
        found = F.coalesce(e["expand"]["trs"], F.array().cast(f"array<{_TORRENT}>"))
        each = F.forall(found, lambda t: (F.coalesce(t["id"], F.lit("")) != "") & (F.coalesce(t["releaseGroup"], F.lit("")) != "") & t["isBest"].isNotNull())
        return F.coalesce((F.coalesce(e["id"], F.lit("")) != "") & (e["alID"] > 0) & e["trs"].isNotNull() & each & arrays.same_set(F.transform(found, lambda t: t["id"]), e["trs"]), F.lit(False))

    ids = F.transform("r.items", lambda e: e["alID"].cast("string"))
    return parsed.select(*KEYS, F.col("r.page").alias("page"), F.col("r.totalPages").alias("total_pages"), F.col("r.totalItems").alias("total_items"), ids.alias("ids"), F.forall("r.items", sound).alias("sound"), F.col("r.items").alias("items"))


def recommendations(pages: DataFrame) -> DataFrame:
    """Entities of sound pages with their nine sections as saved JSON."""
    read = recommendation_pages(pages).where("sound")
    each = read.select(*KEYS, "page", F.posexplode("items").alias("i", "e")).withColumn("t", F.coalesce(F.col("e.expand.trs"), F.array().cast(f"array<{_TORRENT}>")))
    best, alt = F.filter("t", lambda t: t["isBest"]), F.filter("t", lambda t: ~t["isBest"])
    groups = lambda a: arrays.sorted_set(F.transform(a, lambda t: t["releaseGroup"]))
    blank = lambda c: F.coalesce(c, F.lit(""))
    shown = F.transform("t", lambda t: F.concat(F.when(t["isBest"], "Best: ").otherwise("Alt: "), t["releaseGroup"], F.lit(" ["), t["id"], F.lit("] "), blank(t["tracker"]), F.lit(" "), blank(t["url"])))
    tags = F.flatten(F.transform("t", lambda t: F.transform(F.coalesce(t["tags"], F.array().cast("array<string>")), lambda g: F.concat(t["releaseGroup"], F.lit(": "), g))))
    sections = F.struct(
        groups(best).alias("best"), groups(alt).alias("alt"), text.plain_lines("e.theoreticalBest").alias("unmuxed_best"), text.plain_lines("e.notes").alias("notes"), arrays.sorted_set(tags).alias("tags"),
        groups(F.filter("t", lambda t: F.coalesce(t["dualAudio"], F.lit(False)))).alias("dual_audio"), F.when(F.col("e.incomplete"), F.array(F.lit("Yes"))).otherwise(F.array().cast("array<string>")).alias("incomplete"),
        arrays.sorted_set(F.split(blank(F.col("e.comparison")), ",")).alias("comparisons"), arrays.sorted_set(shown).alias("releases"),
    )
    number = F.col("e.alID").cast("string")
    return _observations(each.withColumn("ord", F.col("page") * 10_000 + F.col("i")), guid=number, title=F.concat(F.lit("AniList "), number), link=F.concat(F.lit(RELEASES_LINK), number, F.lit("/")), metadata=F.to_json(sections))


#: Where changed entities are looked up, and the fields asked for.
LOOKUP, LOOKUP_FIELDS = "https://releases.moe/api/collections/anilist/records", "alID,title_english,title_userPreferred,coverImage_medium"
_FACT = "struct<alID:int,title_english:string,title_userPreferred:string,coverImage_medium:string>"


def lookup_url(ids: Column) -> Column:
    """The address of the records of up to fifty entities (their guids, in order)."""
    wanted = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("alID="), i)), " || ")
    return F.concat(F.lit(f"{LOOKUP}?fields="), F.url_encode(F.lit(LOOKUP_FIELDS)), F.lit("&filter="), F.url_encode(wanted), F.lit("&perPage=50"))


def lookup_facts(pages: DataFrame, *keys: str) -> DataFrame:
    """The keys and the records of each response (column body) in order, as ``with_anime_titles`` takes them; a response without records gives none."""
    read = pages.select(*keys, F.from_json("body", f"items array<{_FACT}>")["items"].alias("items"))
    return read.select(*keys, F.posexplode("items").alias("ord", "f")).select(*keys, "f.*", "ord")


def with_anime_titles(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Changed entities with title and cover from the first matching record (alID, title_english, title_userPreferred, coverImage_medium, ord)."""
    keys = [c for c in KEYS if c in facts.columns]  # records of one poll's lookups hold for that poll
    first = facts.groupBy(*keys, F.col("alID").cast("string").alias("guid")).agg(F.min_by(F.struct("title_english", "title_userPreferred", "coverImage_medium"), "ord").alias("f"))
    name = F.coalesce(F.nullif(F.trim("f.title_english"), F.lit("")), F.nullif(F.trim("f.title_userPreferred"), F.lit("")), F.col("title"))
    image = F.concat(F.lit('<img src="'), text.escape_html("f.coverImage_medium"), F.lit('" alt="'), text.escape_html(name), F.lit('" width="100">'))
    cover = F.when(urls.is_web(F.col("f.coverImage_medium")), image).otherwise(F.lit(""))
    joined = items.join(first, [*keys, "guid"], "left")
    return joined.select(*[name.alias(c) if c == "title" else F.concat(cover, F.col("description")).alias(c) if c == "description" else F.col(c) for c in items.columns])


_ENTRY_LINK = re.compile(rf"^(?:https?://{STACK_HOST})?/anime/([1-9][0-9]*)(?:/|$)")
_STACK = "ok boolean, declared int, entries array<struct<id:string,title:string,notes:array<string>>>"


def _stack(page: str | None, stack: str) -> tuple:
    nodes, bad = html.tree(page), (False, None, None)
    has = lambda n, name: name in (n[6].get("class") or "") and name in n[6]["class"].split()
    below = lambda n: nodes[n[0] : n[2] + 1]
    words = lambda n: "".join([m[7] for m in below(n) if m[4] == "text"])
    meta = {}
    for n in nodes:
        if n[5] == "meta":
            meta.setdefault(n[6].get("property"), n[6].get("content", ""))
    at = urlsplit((meta.get("og:url") or "").strip())
    counts = re.findall(r"([0-9]+)\s+Entr(?:y|ies)", meta.get("og:description") or "")
    detail = next((n for n in nodes if n[5] == "div" and has(n, "content-left") and has(n, "stacks-detail")), None)
    if at.netloc != STACK_HOST or at.path != f"/stacks/{stack}" or not counts or detail is None:
        return bad
    classed = [n for n in below(detail) if n[6]]
    if any(n[6].get("rel") == "next" or has(n, "pagination") for n in classed):
        return bad
    cards = next((n for n in classed if n[5] == "div" and has(n, "list-anime-list")), None)
    if cards is None:
        return bad
    links = [n[0] for n in classed if n[5] == "a" and has(n, "link-title")]
    intros = [n[0] for n in classed if n[5] == "div" and has(n, "intro")]
    entries = []
    for card in (n for n in classed if n[1] == cards[0] and n[5] == "div" and has(n, "seasonal-anime")):
        link, intro = html.first_within(nodes, links, card), html.first_within(nodes, intros, card)
        found = _ENTRY_LINK.match((link[6].get("href") or "").strip()) if link else None
        title = words(link).strip() if found else ""
        if not found or intro is None or not title:
            return bad
        entries.append((found[1], title, _tidy(tree_text(below(intro)))))
    ids = [e[0] for e in entries]
    return (len(set(ids)) == len(ids) == int(counts[-1]), int(counts[-1]), entries)


def _tidy(raw: str) -> list[str]:
    lines: list[str] = []
    for line in raw.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = " ".join(line.split())
        if line or lines and lines[-1]:
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def stack_entries(pages: DataFrame, stack: str) -> DataFrame:
    """Entries of whole stack pages, in order; an empty stack that says so is whole."""

    def read(page: str | None) -> list[tuple]:
        ok, declared, entries = _stack(page, stack)
        return [(ok, declared, None if entries is None else [dict(zip(("id", "title", "notes"), e)) for e in entries])]

    return html.page_rows(pages.select("source_id", F.col("epoch").cast("bigint").alias("epoch"), "body"), "body", read, _STACK, *KEYS)


def stack(pages: DataFrame, number: str) -> DataFrame:
    each = stack_entries(pages, number).where("ok").select(*KEYS, F.posexplode("entries").alias("ord", "e"))
    note = F.to_json(F.struct(F.lit(1).alias("version"), F.col("e.notes").alias("notes")))
    return _observations(each, guid=F.col("e.id"), title=F.col("e.title"), link=F.concat(F.lit(f"https://{STACK_HOST}/anime/"), F.col("e.id")), metadata=note)


def _films(page: str | None) -> list[tuple]:
    """Place of each article, address and text of the first anchor in its first title."""
    nodes = html.tree(page, frozenset(("a",)))
    titles = [n[0] for n in nodes if n[4] == "element" and html.of_class(n, "entry-title")]
    anchors, found = [n[0] for n in nodes if n[5] == "a"], []
    for n in nodes:
        if n[4] == "element" and html.of_class(n, "type-films"):
            title = html.first_within(nodes, titles, n)
            anchor = html.first_within(nodes, anchors, title) if title else None
            if anchor:
                found.append((n[0], anchor[6].get("href", ""), anchor[7]))
    return found


def films(pages: DataFrame) -> DataFrame:
    """Films of the archive: the first anchor in each article's title."""
    anchors = html.page_rows(pages, "body", _films, "article int, href string, text string", *KEYS)
    link = F.trim("href")
    path = F.coalesce(urls.part(link, "PATH"), F.regexp_extract(link, r"^[^?#]*", 0))
    found = anchors.where(urls.on_site(link, [FILM_HOST], FILM_PATH) & ~link.rlike("(?i)^http://")).select(*KEYS, F.col("article").alias("ord"), F.regexp_extract(path, FILM_PATH, 1).alias("slug"), text.collapse_space("text").alias("title")).where("title <> ''")
    return _first_of(_observations(found, guid=F.concat(F.lit("visionario:film:"), F.col("slug")), title=F.col("title"), link=F.concat(F.lit(f"https://{FILM_HOST}/films/"), F.col("slug"), F.lit("/"))))


def film_notes(pages: DataFrame, *keys: str) -> DataFrame:
    """The keys (source_id, guid unless given), kind, opening, halls, reason from films' own pages (columns: keys, body); reason says why one is unreadable."""
    keys = keys or ITEM
    tags = ("div", "span", "p", "a", "li", "h1", "h2", "h3", "h4", "strong", "em", "section")
    nodes = html.elements(html.dom_nodes(pages, "body", *keys, text_of=tags)).withColumn("said", text.collapse_space(F.coalesce("text", F.lit(""))))
    of = lambda cls: F.transform(F.array_sort(F.collect_list(F.when(html.has_class(cls) & (F.col("said") != ""), F.struct("pos", "said")))), lambda x: x["said"])
    one = nodes.groupBy(*keys).agg(of("primaVisione").alias("badges"), of("inizio").alias("openings"), of("innerInfo").alias("infos"))
    badge = arrays.single_value(F.transform("badges", F.lower))
    kind = F.when(badge.contains("prima visione") | badge.contains("anteprima"), "release").when(badge.contains("evento"), "event")
    opening = arrays.single_value(F.col("openings"))
    halls = arrays.kept_in_order(F.transform("infos", lambda x: F.when(x == "Cinema Centrale", "Centrale").otherwise(x)), ["Visionario", "Centrale"])
    read = one.select(*keys, kind.alias("kind"), opening.alias("opening"), halls.alias("halls"), F.size(F.array_distinct("openings")).alias("n_openings"))
    reason = F.when(F.col("kind").isNull(), "no recognised badge").when((F.col("n_openings") > 1) | (F.col("n_openings") == 1) & ~F.col("opening").rlike(OPENING), "unrecognised opening").when((F.col("kind") == "release") & F.col("opening").isNull(), "no opening date")
    return read.select(*keys, "kind", "opening", "halls", reason.alias("reason"))


def film_description(opening: Column, halls: Column) -> Column:
    return F.array_join(F.concat(F.array(opening), halls), ", ")


def screenings(pages: DataFrame) -> DataFrame:
    """Films linked from the programme, but not by a link that only says more."""
    rows = html.page_rows(pages, "body", lambda page: html.anchor_texts(page, "properties"), "pos int, href string, content string", *KEYS)
    link = F.trim("href")
    path = F.regexp_replace(F.coalesce(urls.part(link, "PATH"), F.regexp_extract(link, r"^[^?#]*", 0)), "/$", "")
    film = F.coalesce(urls.query_value(link, "id_pro"), F.regexp_extract(link, r"[?&]id_pro=([^&#]*)", 1))
    anchors = rows.where((urls.on_site(link, [CINEMA_HOST], ".*") | path.isin("scheda-film")) & path.isin("/scheda-film", "scheda-film")).withColumn("id", film).where(F.col("id").rlike("^[0-9]+$"))
    found = anchors.select(*KEYS, "pos", "id", "content").withColumn("title", text.collapse_space("content")).where((F.col("title") != "") & ~F.lower("title").isin(MORE_LINKS))
    return _first_of(_observations(found.withColumnRenamed("pos", "ord"), guid=F.concat(F.lit("citta-fiera:film:"), F.col("id")), title=F.col("title"), link=F.concat(F.lit(f"https://{CINEMA_HOST}/scheda-film/?id_pro="), F.col("id"))))


def screening_notes(pages: DataFrame, *keys: str) -> DataFrame:
    """The keys (source_id, guid unless given), first_day, director, duration from films' own pages (columns: keys, body); first_day is null if unreadable."""
    keys = keys or ITEM
    nodes = html.dom_nodes(pages, "body", *keys, text_of=("strong", "p", "div", "li", "td", "span"))
    el = html.elements(nodes)
    day = F.regexp_extract(F.try_url_decode(F.regexp_extract(html.attribute("href"), r"[?&]d=([^&#]*)", 1)), r"^\s*(\S+)", 1)
    days = el.where("tag = 'a'").select(*keys, day.alias("d")).where("d <> ''").groupBy(*keys).agg(F.min(F.try_to_timestamp("d", F.lit("yyyy-MM-dd"))).alias("low"), F.sum(F.try_to_timestamp("d", F.lit("yyyy-MM-dd")).isNull().cast("int")).alias("bad"))
    parents = el.select(*keys, F.col("pos").alias("parent"), F.col("text").alias("whole"))
    labels = el.where("tag = 'strong'").withColumn("label", text.collapse_space("text")).where(F.col("label").isin("Regista:", "Durata:")).join(parents, [*keys, "parent"])
    value = F.trim(F.substr(text.collapse_space("whole"), F.length("label") + 1))
    first = labels.groupBy(*keys).agg(F.min_by(F.when(F.col("label") == "Regista:", value), F.when(F.col("label") == "Regista:", F.col("pos"))).alias("director"), F.min_by(F.when(F.col("label") == "Durata:", value), F.when(F.col("label") == "Durata:", F.col("pos"))).alias("duration"))
    return days.join(first, list(keys), "left").select(*keys, F.when(F.col("bad") == 0, F.to_date("low")).alias("first_day"), "director", "duration")


def screening_description(first_day: Column, director: Column, duration: Column) -> Column:
    return text.join_parts(dates.italian_date(first_day), director, duration, by=", ")


def embedded_release(src: Column) -> Column:
    """struct kind, id of a player address: a video, or an album before a track; null for any other."""
    u = F.when(F.trim(src).startswith("//"), F.concat(F.lit("https:"), F.trim(src))).otherwise(F.trim(src))
    host, path = urls.part(u, "HOST"), F.coalesce(urls.part(u, "PATH"), F.lit(""))
    video = F.regexp_extract(path, r"^/embed/([^/]+)", 1)
    albums = F.transform(F.regexp_extract_all(path, F.lit(r"(?<=/)album=([^/]*)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    tracks = F.transform(F.regexp_extract_all(path, F.lit(r"(?<=/)track=([^/]*)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    whole = lambda ids: (F.size(ids) > 0) & F.forall(ids, lambda i: F.coalesce(i > 0, F.lit(False)))
    made = lambda kind, id: F.struct(F.lit(kind).alias("kind"), id.alias("id"))
    player = host.isin(PLAYER_HOSTS) & path.startswith("/EmbeddedPlayer/")
    return F.when(
        u.startswith("https://"),
        F.when(host.isin(VIDEO_HOSTS) & video.rlike(VIDEO_ID), made("youtube", video))
        .when(player & (F.size(albums) > 0), F.when(whole(albums), made("album", F.get(albums, F.lit(0)).cast("string"))))
        .when(player & whole(tracks), made("track", F.get(tracks, F.lit(0)).cast("string"))),
    )


def release_guid(kind: Column, id: Column) -> Column:
    prefix = F.when(kind == "youtube", "acloserlisten:youtube:").when(kind == "track", "acloserlisten:bandcamp:track:").when(kind == "named", "acloserlisten:named:").otherwise("acloserlisten:bandcamp:album:")
    return F.concat(prefix, id)


def release_of(guid: Column) -> Column:
    """struct kind, id of a guid; the album's prefix is tried last. Null for any other."""
    rest = lambda p: F.substr(guid, F.lit(len(p) + 1))
    made = lambda kind, p, ok: F.when(ok(rest(p)), F.struct(F.lit(kind).alias("kind"), rest(p).alias("id")))
    number = lambda x: text.positive_id(x).isNotNull()
    return (
        F.when(guid.startswith("acloserlisten:named:"), made("named", "acloserlisten:named:", lambda x: x.rlike(r"^[\p{Ll}\p{Lo}\p{Lm}\p{Nd}]+:[\p{Ll}\p{Lo}\p{Lm}\p{Nd}]+$")))
        .when(guid.startswith("acloserlisten:youtube:"), made("youtube", "acloserlisten:youtube:", lambda x: x.rlike(VIDEO_ID)))
        .when(guid.startswith("acloserlisten:bandcamp:track:"), made("track", "acloserlisten:bandcamp:track:", number))
        .when(guid.startswith("acloserlisten:bandcamp:album:"), made("album", "acloserlisten:bandcamp:album:", number))
    )


def player_url(kind: Column, id: Column) -> Column:
    watch = F.url_encode(F.concat(F.lit("https://www.youtube.com/watch?v="), id))
    return (
        F.when(kind == "youtube", F.concat(F.lit("https://www.youtube.com/oembed?format=json&url="), watch))
        .when(kind == "track", F.concat(F.lit("https://bandcamp.com/EmbeddedPlayer/v=2/track="), id, F.lit(PLAYER_SUFFIX)))
        .when(kind == "album", F.concat(F.lit("https://bandcamp.com/EmbeddedPlayer/v=2/album="), id, F.lit(PLAYER_SUFFIX)))
        .otherwise(F.lit(""))
    )


def _runs(page: str | None) -> list[tuple]:
    """Place, tag, text, address and label of bold and italic runs and players. A bold run with a line break
    among its children is a genre: its label is the text before the break."""
    nodes, said, labels, found = html.tree(page, frozenset(("strong", "em"))), {}, {}, []
    for n in nodes:
        if n[4] == "text":
            said.setdefault(n[1], []).append(n[7])
        elif n[5] == "br" and n[1] not in labels:
            labels[n[1]] = "".join(said.get(n[1], ())).strip(" ")
    for n in nodes:
        if n[5] in ("strong", "em", "iframe"):
            found.append((n[0], n[5], n[7], n[6].get("src", ""), labels.get(n[0])))
    return found


def releases(pages: DataFrame) -> DataFrame:
    """Releases in the order of the text: named in prose (bold artist, then the next title) or embedded."""
    read = pages.select(*KEYS, F.from_json("body", "ID int, content string").alias("r")).where(f"r.ID = {RECOMMENDATION_PAGE} and r.content is not null").select(*KEYS, F.col("r.content").alias("content"))
    rows = html.page_rows(read, "content", _runs, "pos int, tag string, text string, src string, label string", *KEYS)
    is_genre = (F.col("tag") == "strong") & (F.coalesce("label", F.lit("")) != "")
    name = F.when((F.col("tag") == "strong") & ~is_genre, F.nullif(text.clean_name(F.trim("text")), F.lit("")))
    order = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("name", name).withColumn("title", F.when(F.col("tag") == "em", F.nullif(text.clean_name("text"), F.lit(""))))
    rows = rows.withColumn("genre", F.last(F.when(is_genre, F.col("label")), ignorenulls=True).over(order)).withColumn("run", F.sum((is_genre | F.col("name").isNotNull()).cast("int")).over(order))
    within = Window.partitionBy(*KEYS, "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("artist", F.first("name").over(within)).withColumn("nth", F.count("title").over(within))
    named = F.when((F.col("tag") == "em") & F.col("title").isNotNull() & F.col("artist").isNotNull() & (F.col("nth") == 1), text.prose_slug("artist", "title"))
    r = F.when(F.col("tag") == "iframe", embedded_release(F.col("src"))).when(named.isNotNull(), F.struct(F.lit("named").alias("kind"), named.alias("id")))
    found = rows.withColumn("r", r).where("r.id is not null").withColumnRenamed("pos", "ord")
    title = F.when(F.col("r.kind") == "named", F.concat("artist", F.lit(" — "), "title")).otherwise(F.lit(""))
    return _first_of(_observations(found, guid=release_guid(F.col("r.kind"), F.col("r.id")), title=title, link=F.lit(RECOMMENDATIONS), description=text.genre_description("genre")))


_PLAYER = "struct<album_id:bigint,artist:string,album_title:string,tracks:array<struct<id:bigint,artist:string,title:string>>>"


def players(pages: DataFrame, *keys: str) -> DataFrame:
    """The keys (source_id, guid unless given), album_id, artist, album_title, tracks from player pages: JSON in the first data attribute."""
    keys = keys or ITEM
    nodes = html.dom_nodes(pages, "body", *keys)
    first = html.first_element(html.elements(nodes).where(html.attribute("data-player-data") != ""), *keys)
    return first.select(*keys, F.from_json(html.attribute("data-player-data"), _PLAYER).alias("p")).where("p is not null").select(*keys, "p.*")


def resolve_players(items: DataFrame, read: DataFrame) -> DataFrame:
    """Items with album identity, title and names from their player; ``reason`` where it serves another or lacks the track."""
    joined = items.join(read, ["source_id", "guid"], "left").withColumn("r", release_of(F.col("guid")))
    needs = F.col("r.kind").isin("album", "track")
    track = arrays.find_by_id(F.col("tracks"), "id", F.col("r.id").cast("bigint"))
    known = F.coalesce(F.col("album_id") > 0, F.lit(False))
    reason = (
        F.when(needs & F.col("tracks").isNull() & F.col("album_id").isNull() & F.col("artist").isNull(), "no player")
        .when((F.col("r.kind") == "album") & ~F.coalesce(F.col("album_id").cast("string") == F.col("r.id"), F.lit(False)), "another album")
        .when((F.col("r.kind") == "track") & track.isNull(), "no such track")
    )
    artist, album = F.btrim(F.coalesce("artist", F.lit(""))), F.btrim(F.coalesce("album_title", F.lit("")))
    named = needs & known & (artist != "") & (album != "")
    filled = lambda c: F.nullif(F.btrim(c), F.lit(""))
    single = F.concat(F.coalesce(filled(artist), filled(track["artist"])), F.lit(" — "), filled(track["title"]))
    guid = F.when((F.col("r.kind") == "track") & known & reason.isNull(), release_guid(F.lit("album"), F.col("album_id").cast("string"))).otherwise(F.col("guid"))
    title = F.when(named, F.concat(artist, F.lit(" — "), album)).when((F.col("r.kind") == "track") & ~known, F.coalesce(single, F.col("title"))).otherwise(F.col("title"))
    names = F.when(F.col("r.kind") == "named", F.array("r.id")).when(named, text.album_names(artist, album)).otherwise(F.array().cast("array<string>"))
    columns = [guid.alias("guid") if c == "guid" else title.alias("title") if c == "title" else F.col(c) for c in items.columns]
    return joined.select(*columns, names.alias("names"), reason.alias("reason"))


def video_title(title: Column, author: Column) -> Column:
    """``artist — title`` of a video: split where the lead is the channel's own name."""
    t, a = F.btrim(title), F.btrim(author)
    artist = F.regexp_replace(F.regexp_replace(a, r" - Topic$", ""), r"VEVO$", "")
    found = F.lit(None).cast("string")
    for mark in (" - ", " – ", " — "):  # the last tried first wins below
        lead, rest = F.substring_index(t, mark, 1), F.substr(t, F.instr(t, mark) + len(mark))
        same = (F.instr(t, mark) > 0) & (text.fold_name(lead) != "") & (text.fold_name(lead) == text.fold_name(artist))
        found = F.when(same, F.concat(F.btrim(lead), F.lit(" — "), F.btrim(rest))).otherwise(found)
    return F.coalesce(found, F.concat(a, F.lit(" — "), t))


def _claims(guids: Iterable[str], names: dict) -> pd.DataFrame:
    """guid, name: a named release claims the name that it is, an album those known for it, a track none."""
    of = lambda guid: [guid.partition(":named:")[2]] if ":named:" in guid else names.get(guid, [])
    return pd.DataFrame([(g, n) for g in guids for n in of(g)], columns=["guid", "name"], dtype=object)


def first_holders(claims: pd.DataFrame) -> set[int]:
    """Of claims (place, name) the places that hold all their names, where an earlier place goes before a later one.

    In rounds over the graph of shared names: who is first at each of its names holds them, and who
    shares one with a holder is out. The first of all open places is always a holder, so a round ends some.
    """
    held: set[int] = set()
    while len(claims):
        first = claims.groupby("name").place.transform("min") == claims.place
        holds = first.groupby(claims.place).transform("all")
        held |= set(claims.place[holds])
        met = claims.place[claims.name.isin(claims.name[holds])]
        claims = claims[~claims.place.isin(met)]
    return held


def decide_releases(state: dict, items: list[dict]) -> list[dict]:
    """One poll of the release feed: books every candidate, returns those to announce, in page order.

    ``state`` has announced (set of guids) and names (guid to names) and is changed in place; items are in
    page order with guid and names. What was booked holds its names; so do the page's albums against
    releases that are only named; the rest is settled by ``first_holders``.
    """
    page = pd.DataFrame({"guid": pd.Series([i["guid"] for i in items], dtype=object)})
    albums = page.guid.str.contains(":album:", regex=False)
    state["names"].update({i["guid"]: list(i["names"]) for i, album in zip(items, albums) if album and i.get("names") is not None and len(i["names"])})
    taken = set(_claims(state["announced"], state["names"]).name)
    played = set(_claims(page.guid[albums], state["names"]).name)
    new = page[~page.guid.isin(state["announced"]) & ~page.guid.duplicated()]
    claims = _claims(new.guid, state["names"])
    claims["place"] = claims.guid.map(dict(zip(new.guid, new.index)))
    barred = claims.name.isin(taken) | claims.guid.str.contains(":named:", regex=False) & claims.name.isin(played)
    free = set(new.index) - set(claims.place) | first_holders(claims[~claims.place.isin(claims.place[barred])])
    state["announced"].update(new.guid)
    return [items[place] for place in sorted(free)]


def announce_releases(observed: DataFrame) -> DataFrame:
    """source_id, epoch, guid over all epochs (columns source_id, epoch, ord, guid, names): a fold of polls per source."""
    html.importable(observed.sparkSession)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        state, rows = {"announced": set(), "names": {}}, []
        for epoch, poll in frame.sort_values(["epoch", "ord"]).groupby("epoch", sort=True):
            rows += [(frame.source_id.iloc[0], epoch, i["guid"]) for i in decide_releases(state, poll[["guid", "names"]].to_dict("records"))]
        return pd.DataFrame(rows, columns=["source_id", "epoch", "guid"])

    return observed.select("source_id", "epoch", "ord", "guid", "names").groupBy("source_id").applyInPandas(fold, "source_id string, epoch bigint, guid string")


#: Registered extractors by source id.
FLOWS = {
    "citta-fiera": screenings, "visionario": films, "acloserlisten": releases, "coached-essays": essays, "seadex": recommendations, "meltzer-5-star-matches": matches, "one-piece": chapters,
    "ptg": lambda pages: catalog(pages, "ptg"), "film": lambda pages: catalog(pages, "film"), "mal-stack-82158": lambda pages: stack(pages, "82158"), "mal-stack-38814": lambda pages: stack(pages, "38814"),
}
