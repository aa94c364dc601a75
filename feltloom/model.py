"""Schemas of the engine's tables. Nothing is ever inferred."""

from __future__ import annotations

META = "struct<title:string,description:string,link:string,html:boolean>"
HISTORY = "struct<visible:int,stored:int,min_live:int>"

#: Configuration: one row per source.
SOURCES = f"id string, url string, mode string, extract_version int, needs_full_page boolean, interval_s bigint, history {HISTORY}, meta {META}, policy string"
#: Bronze, append-only: every response, in poll order.
PAGE_LOG = "source_id string, epoch bigint, url string, page_no int, status int, etag string, last_modified string, retry_after string, body string, fetched_at timestamp"
#: Bronze, append-only: responses of items' own pages (film pages, players), by the poll they were read in.
ITEM_LOG = "source_id string, epoch bigint, guid string, url string, status int, retry_after string, body string, fetched_at timestamp"
#: Elements and texts of parsed pages, in document order.
DOM_NODES = "pos int, parent int, subtree_end int, depth int, kind string, tag string, attrs map<string,string>, text string"
#: Items as extracted: pub_date may be unknown, ord is the order on the page.
OBSERVATIONS = "source_id string, epoch bigint, ord int, guid string, title string, link string, description string, metadata string, pub_date timestamp, replies int"
#: Items as published.
FEED_ITEMS = "source_id string, guid string, title string, link string, description string, metadata string, pub_date timestamp, replies int"
KEYED_TIME = "source_id string, guid string, ts timestamp"
LIVE = "source_id string, guid string"
FETCH_STATE = "source_id string, etag string, last_modified string, extract_version int"
REJECTS = "source_id string, epoch bigint, guid string, stage string, reason string"
#: The work queue: items' pages that a source's last poll lacked, and how many polls have lacked them.
PENDING = "source_id string, guid string, purpose string, url string, attempts int, epoch bigint"
#: Announcement checkpoints beside what was announced: where numbers began, albums' names, tracks' releases, held days.
ANNOUNCE_STATE, ALIASES, TRACKS, HELD = "source_id string, initial bigint", "source_id string, guid string, names array<string>", "source_id string, track string, guid string", "source_id string, guid string, day date"
#: Gold: feeds as they are served, with what they were rendered from.
DOCUMENTS = "source_id string, kind string, digest string, body string, etag string"
CHANGE_STATE = "source_id string, version int, revision bigint, initialized boolean"

# The history policy, bounds and pacing that results depend on.
VISIBLE_LIMIT, STORED_LIMIT, MIN_LIVE_REPLIES = 10, 11, 100
MAX_BODY_BYTES, MAX_PAGES, ENRICH_BATCH, HOLD_DAYS = 16 * 1024 * 1024, 1000, 50, 14
INITIAL_BACKOFF_S, MAX_BACKOFF_S, DOMAIN_SPACING_S, DEFAULT_INTERVAL_S = 60, 3600, 10, 3600
