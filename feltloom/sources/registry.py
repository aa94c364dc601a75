"""The registered sources: a configuration table, checked when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feltloom.model import DEFAULT_INTERVAL_S, MIN_LIVE_REPLIES, SOURCES, STORED_LIMIT, VISIBLE_LIMIT
from feltloom.operators.gates import validate_sources

_BOARD = {"visible": VISIBLE_LIMIT, "stored": STORED_LIMIT, "min_live": MIN_LIVE_REPLIES}


def _source(id: str, url: str, mode: str, version: int, title: str, description: str, link: str, html: bool = False, history: dict | None = None, policy: str | None = None) -> dict:
    whole = mode == "announcement" or id == "seadex"
    return {"id": id, "url": url, "mode": mode, "extract_version": version, "needs_full_page": whole, "interval_s": None, "history": history, "meta": {"title": title, "description": description, "link": link, "html": html}, "policy": policy}


#: The sources in the order of registration.
REGISTERED = [
    _source("citta-fiera", "https://www.cine-cittafiera.com/", "announcement", 1, "Cine Città Fiera", "New films at Cine Città Fiera in Udine, announced once the first screening is within two weeks.", "https://www.cine-cittafiera.com/programmazione/", policy="window"),
    _source("visionario", "https://visionario.movie/films/", "announcement", 1, "Visionario and Cinema Centrale", "New films at Visionario and Cinema Centrale in Udine, announced once per film.", "https://visionario.movie/", policy="read_once"),
    _source("acloserlisten", "https://public-api.wordpress.com/rest/v1.1/sites/acloserlisten.com/posts/395?fields=ID,content", "announcement", 4, "A Closer Listen recommendations", "New recommended releases, announced once per prose album name, Bandcamp album, standalone track, or YouTube video.", "https://acloserlisten.com/recommendations/", policy="names"),
    _source("coached-essays", "https://coached.com/essays/", "projection", 2, "Coached essays", "Essays by Rohan Mahtani on life and career strategy, announced once per essay.", "https://coached.com/essays/"),
    _source("seadex", "https://releases.moe/api/collections/entries/records?perPage=500&sort=id&expand=trs&fields=id,alID,notes,theoreticalBest,incomplete,comparison,trs,expand.trs.id,expand.trs.releaseGroup,expand.trs.isBest,expand.trs.tags,expand.trs.dualAudio,expand.trs.url,expand.trs.tracker", "change", 2, "SeaDex recommendation changes", "Observed changes to Best, Alt, Unmuxed Best and notes; silent initial baseline.", "https://releases.moe/", html=True),
    _source("meltzer-5-star-matches", "https://en.wikipedia.org/wiki/List_of_professional_wrestling_matches_rated_5_or_more_stars_by_Dave_Meltzer", "projection", 1, "Dave Meltzer 5-star wrestling matches", "Professional wrestling matches rated 5 or more stars by Dave Meltzer.", "https://en.wikipedia.org/wiki/List_of_professional_wrestling_matches_rated_5_or_more_stars_by_Dave_Meltzer"),
    _source("ptg", "https://a.4cdn.org/g/catalog.json", "history", 7, "Private Trackers General", "Latest /ptg/ opening posts via the board catalog.", "https://boards.4chan.org/g/catalog#s=ptg", history=_BOARD),
    _source("film", "https://a.4cdn.org/tv/catalog.json", "history", 6, "Arthouse & Classic Cinema", "Latest /film/ opening posts via the board catalog.", "https://boards.4chan.org/tv/catalog#s=film", history=_BOARD),
    _source("one-piece", "https://tcbonepiecechapters.com/mangas/5/one-piece", "announcement", 1, "One Piece chapters", "New One Piece chapter releases from TCB Scans.", "https://tcbonepiecechapters.com/mangas/5/one-piece", policy="numbers"),
    _source("mal-stack-82158", "https://myanimelist.net/stacks/82158", "change", 1, "MyAnimeList: New Anime IPs with Exceptional Production Value", "Observed additions, removals, and curator note edits to the Interest Stack.", "https://myanimelist.net/stacks/82158", html=True),
    _source("mal-stack-38814", "https://myanimelist.net/stacks/38814", "change", 1, "MyAnimeList: The Next Sakuga Shows", "Observed additions, removals, and curator note edits to the Interest Stack.", "https://myanimelist.net/stacks/38814", html=True),
]


def sources(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    rows = REGISTERED if rows is None else rows
    validate_sources(rows)
    return spark.createDataFrame(rows, SOURCES)


def effective_interval(row: dict) -> int:
    return row.get("interval_s") or DEFAULT_INTERVAL_S
