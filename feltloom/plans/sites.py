"""Registered queries of the nine sites' extractors, each beside its SQL.

An order is one poll of a site and its lines are the site's items, so pages are small and as many as there are orders. The
markup is made from the lines; the SQL states what the site's rules make of them, from the lines alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltloom.plans import flows
from feltloom.plans.queries import query, table

_FIRST = "QUALIFY row_number() OVER (PARTITION BY epoch, guid ORDER BY l_linenumber, l_extendedprice, l_partkey) = 1"


def _line(template: str) -> str:
    """SQL for text with the columns of a line in braces."""
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(f"cast({piece} as string)" if i % 2 else "'" + piece.replace("\\", "\\\\").replace("'", "\\'") + "'")
    return f"concat({', '.join(parts)})"


def _pages(spark: SparkSession, sf_dir: str, line: str, by: str = "") -> DataFrame:
    """source_id, epoch, body: the markup of each order's lines in their order, and how many there are (n).

    Lines are brought together by their columns; the markup (SQL of a line's columns) is made where a page is one row, as it is far wider.
    """
    place = ("l_linenumber", "l_extendedprice", "l_partkey")
    columns = [*place, *sorted(set(re.findall(r"\bl_\w+", line)) - set(place)), "l_shipdate"]
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("epoch")).agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys(columns)))).alias("all"))
    piece = re.sub(r"\bl_\w+", r"x.\g<0>", line)
    body = F.array_join(F.expr(f"transform(all, x -> {piece})"), by)
    return pages.select(F.lit("site").alias("source_id"), "epoch", body.alias("body"), F.size("all").cast("bigint").alias("n"), F.get("all", F.lit(0))["l_shipdate"].alias("first_day"))


def _told(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(F.col("epoch").cast("bigint").alias("epoch"), "guid", *columns)


@query(f"""SELECT l_orderkey AS epoch, 'one-piece:chapter:' || l_partkey AS guid, 'One Piece Chapter ' || l_partkey || ' — ' || l_returnflag AS title,
    'https://tcbonepiecechapters.com/chapters/' || l_suppkey || '/one-piece-chapter-' || l_partkey AS link FROM lineitem WHERE l_linestatus = 'O' AND l_partkey > 0 {_FIRST}""")
def site_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter counts if its heading names the number of its link."""
    pages = _pages(spark, sf_dir, _line('<a href="/chapters/{l_suppkey}/one-piece-chapter-{l_partkey}"><div>One Piece Chapter {if(l_linestatus = \'O\', l_partkey, l_partkey + 1)}</div><div> {l_returnflag} </div></a>'))
    return _told(flows.chapters(pages), "title", "link")


@query(f"""SELECT l_orderkey AS epoch, 'visionario:film:part-' || l_partkey AS guid, 'Part ' || l_partkey || ' ' || l_returnflag AS title, 'https://visionario.movie/films/part-' || l_partkey || '/' AS link
    FROM lineitem {_FIRST}""")
def site_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first anchor in the title of each article."""
    pages = _pages(spark, sf_dir, _line('<article class="post type-films"><h2 class="entry-title"><a href="/films/part-{l_partkey}/"> Part  {l_partkey} {l_returnflag} </a><a href="/films/second/">s</a></h2><a href="/films/other/">o</a></article>'))
    return _told(flows.films(pages), "title", "link")


@query(f"""SELECT l_orderkey AS epoch, 'citta-fiera:film:' || l_partkey AS guid, 'Film ' || l_partkey || ' ' || l_returnflag AS title, 'https://www.cine-cittafiera.com/scheda-film/?id_pro=' || l_partkey AS link
    FROM lineitem WHERE l_linestatus = 'O' {_FIRST}""")
def site_screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors without their badge; those that only say more don't count."""
    said = "{if(l_linestatus = 'O', concat('Film ', l_partkey, ' ', l_returnflag), 'Scopri di più')}"
    pages = _pages(spark, sf_dir, _line('<a href="https://www.cine-cittafiera.com/scheda-film/?id_pro={l_partkey}"><b>' + said + '</b> <i class="x properties">3D {l_suppkey}</i></a>'))
    return _told(flows.screenings(pages), "title", "link")


@query("""SELECT l_orderkey AS epoch, 'ptg:' || (l_partkey + 1) AS guid, 'Lot ' || l_suppkey AS title, 'Intro' || chr(10) || 'Line "' || l_returnflag || '"' AS description, CAST(l_quantity AS INT) AS replies
    FROM lineitem WHERE l_linestatus = 'O'""")
def site_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening posts of a board's general; replies to others are none."""
    thread = f"to_json(struct(l_partkey + 1 AS no, {_line('/PTG/ - Lot {l_suppkey}')} AS sub, {_line('Intro<br>Line &quot;{l_returnflag}&quot;')} AS com, 1700000000 + l_linenumber AS time, if(l_linestatus = 'O', 0, 1) AS resto, cast(l_quantity as int) AS replies))"
    pages = _pages(spark, sf_dir, thread, ",").withColumn("body", F.concat(F.lit('[{"page":1,"threads":['), "body", F.lit("]}]")))
    return _told(flows.catalog(pages, "ptg"), "title", "description", "replies")


@query(f"""SELECT l_orderkey AS epoch, 'coached:essay:part-' || l_partkey AS guid, 'Essay ' || l_partkey || ' ' || l_returnflag AS title FROM lineitem {_FIRST}""")
def site_essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the section headed so, in what a browser without scripts reads."""
    pages = _pages(spark, sf_dir, _line('<li><a href="/essays/part-{l_partkey}/"> Essay {l_partkey} {l_returnflag} </a></li>'))
    around = F.concat(F.lit('<a href="/essays/out/">o</a><noscript><h2>Intro</h2><a href="/essays/no/">no</a><h2>All essays</h2><ul>'), "body", F.lit('</ul><h3>Next</h3><a href="/essays/late/">late</a></noscript>'))
    return _told(flows.essays(pages.withColumn("body", around)), "title")


@query("""
    WITH l AS (SELECT *, first_value(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS day FROM lineitem)
    SELECT l_orderkey AS epoch, 'meltzer:' || strftime(day, '%Y-%m-%d') || ':part-' || l_partkey || '-vs-' || l_suppkey || ':order-' || l_orderkey AS guid, 'Part ' || l_partkey || ' vs. ' || l_suppkey || ' — Order ' || l_orderkey AS title,
        l_returnflag || ' · ' || CAST(l_quantity AS INT) || ' stars' AS description FROM l""")
def site_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table whose date cell spans all rows below it."""
    pages = _pages(spark, sf_dir, _line("<tr><td>Part {l_partkey} vs. {l_suppkey}<sup>1</sup></td><td>{l_returnflag}</td><td>Order {l_orderkey}</td><td>{cast(l_quantity as int)}</td><td></td></tr>"))
    head = F.lit("<h2>2020s</h2><table><tr><th>Date</th><th>Match</th><th>Promotion</th><th>Event</th><th>Rating</th><th>Notes</th></tr>")
    dated = F.concat(F.lit('<tr><td rowspan="'), F.col("n").cast("string"), F.lit('">'), F.date_format("first_day", "MMMM d, yyyy"), F.lit("</td>"), F.substring("body", 5, 1 << 30))
    return _told(flows.matches(pages.withColumn("body", F.concat(head, dated, F.lit("</table>")))), "title", "description")


@query("""
    SELECT l_orderkey AS epoch, CAST(l_orderkey + 1 AS VARCHAR) AS guid, 'AniList ' || (l_orderkey + 1) AS title, coalesce(string_agg(DISTINCT 'G' || l_suppkey, ',' ORDER BY 'G' || l_suppkey) FILTER (WHERE l_linestatus = 'O'), '') AS best,
        coalesce(string_agg(DISTINCT 'G' || l_suppkey, ',' ORDER BY 'G' || l_suppkey) FILTER (WHERE l_linestatus <> 'O'), '') AS alt FROM lineitem GROUP BY l_orderkey""")
def site_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity with its recommended and other groups."""
    torrent = f"to_json(struct({_line('t{l_linenumber}')} AS id, {_line('G{l_suppkey}')} AS releaseGroup, l_linestatus = 'O' AS isBest, 'u' AS url))"
    pages = _pages(spark, sf_dir, torrent, ",")
    ids = F.array_join(F.regexp_extract_all("body", F.lit('"id":("[^"]*")'), F.lit(1)), ",")
    entry = F.concat(F.lit('{"page":1,"totalPages":1,"totalItems":1,"items":[{"id":"e","alID":'), (F.col("epoch") + 1).cast("string"), F.lit(',"notes":"","theoreticalBest":"","incomplete":false,"comparison":"","trs":['), ids, F.lit('],"expand":{"trs":['), "body", F.lit("]}}]}"))
    made = F.from_json("metadata", "best array<string>, alt array<string>")
    return _told(flows.recommendations(pages.withColumn("body", entry)).withColumn("m", made).withColumn("best", F.array_join("m.best", ",")).withColumn("alt", F.array_join("m.alt", ",")), "title", "best", "alt")


@query("""
    SELECT l_orderkey AS epoch, CAST(l_partkey + 1 AS VARCHAR) AS guid, 'Show ' || l_partkey AS title, '{"version":1,"notes":["Note ' || l_returnflag || '","","see it (https://k/' || l_suppkey || ')"]}' AS metadata
    FROM lineitem SEMI JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_partkey)) USING (l_orderkey)""")
def site_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of whole stacks: as many as declared, none twice."""
    pages = _pages(spark, sf_dir, _line('<div class="seasonal-anime x"><a class="link-title" href="/anime/{l_partkey + 1}/t"> Show {l_partkey} </a><div class="intro">Note {l_returnflag}<br><br>see <a href="https://k/{l_suppkey}">it</a></div></div>'))
    head = F.concat(F.lit('<head><meta property="og:url" content="https://myanimelist.net/stacks/82158"><meta property="og:description" content="'), F.col("n").cast("string"), F.lit(' Entries"></head><div class="content-left stacks-detail"><div class="list-anime-list">'))
    return _told(flows.stack(pages.withColumn("body", F.concat(head, "body", F.lit("</div></div>"))), "82158"), "title", "metadata")


@query(f"""
    SELECT l_orderkey AS epoch, CASE WHEN l_linestatus = 'O' THEN 'acloserlisten:named:artist' || l_suppkey || ':album' || l_partkey ELSE 'acloserlisten:bandcamp:album:' || (l_partkey + 1) END AS guid,
        CASE WHEN l_linestatus = 'O' THEN 'Artist ' || l_suppkey || ' — Album ' || l_partkey ELSE '' END AS title, 'Genre: Field ' || l_returnflag AS description FROM lineitem {_FIRST}""")
def site_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases in the order of the text: named in prose below a genre, or embedded."""
    named = "<strong>Artist {l_suppkey}</strong> <em>Album {l_partkey}</em>"
    player = "<iframe src=https://bandcamp.com/EmbeddedPlayer/v=2/album={l_partkey + 1}/></iframe>"
    line = f"concat({_line('<p><strong>Field {l_returnflag}<br></strong></p>')}, if(l_linestatus = 'O', {_line(named)}, {_line(player)}))"
    pages = _pages(spark, sf_dir, line)
    return _told(flows.releases(pages.withColumn("body", F.to_json(F.struct(F.lit(395).alias("ID"), F.col("body").alias("content"))))), "title", "description")
