"""Feeds rendered by expressions: one row per feed, items in feed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltloom.functions.dates import long_date, rfc1123z
from feltloom.functions.text import content_tag, escape_html, escape_xml

# The document around the items.
XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n  <channel>\n'
XML_TAIL = "  </channel>\n</rss>"


def rss_item(title: Column, link: Column, description: Column, guid: Column, pub_date: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"      <{name}>"), value, F.lit(f"</{name}>\n"))
    return F.concat(
        F.lit("    <item>\n"), line("title", escape_xml(title)), line("link", escape_xml(link)), line("description", escape_xml(description)),
        F.concat(F.lit('      <guid isPermaLink="false">'), escape_xml(guid), F.lit("</guid>\n")), line("pubDate", rfc1123z(pub_date)), F.lit("    </item>\n"),
    )


def html_item(title: Column, link: Column, description: Column, pub_date: Column) -> Column:
    """``description`` must be escaped or sanitised already."""
    return F.concat(
        F.lit('<li>\n<a class="item-title" href="'), escape_html(link), F.lit('">'), escape_html(title), F.lit('</a>\n<p class="item-date">'), F.coalesce(long_date(pub_date), F.lit("")), F.lit("</p>\n"),
        F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit('<div class="meta">'), description, F.lit("</div>\n"))).otherwise(F.lit("")), F.lit("</li>\n"),
    )


def _ordered(rendered: Column) -> Column:
    """Items of a feed in its order: newest first, then by guid."""
    entry = F.struct((-F.unix_micros("pub_date")).alias("when"), F.col("guid").alias("guid"), rendered.alias("text"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("guid").isNotNull(), entry))), lambda x: x["text"]), "")


def rss_feeds(sources: DataFrame, items: DataFrame) -> DataFrame:
    """source_id, body, etag. Feeds hold a bounded number of items, so each fits a row; one without items is there too."""
    joined = sources.select(F.col("id").alias("source_id"), "meta").join(items, "source_id", "left")
    body = _ordered(rss_item(F.col("title"), F.col("link"), F.col("description"), F.col("guid"), F.col("pub_date")))
    one = joined.groupBy("source_id").agg(F.first("meta").alias("meta"), body.alias("items"))
    line = lambda name: F.concat(F.lit(f"    <{name}>"), escape_xml(F.coalesce(F.col(f"meta.{name}"), F.lit(""))), F.lit(f"</{name}>\n"))
    made = one.select("source_id", F.concat(F.lit(XML_HEAD), line("title"), line("link"), line("description"), "items", F.lit(XML_TAIL)).alias("body"))
    return made.withColumn("etag", content_tag("body"))


def html_feeds(sources: DataFrame, items: DataFrame) -> DataFrame:
    """source_id, body, etag. Descriptions of sources that render HTML must have been through ``safe_html``."""
    joined = sources.select(F.col("id").alias("source_id"), "meta").join(items, "source_id", "left")
    shown = F.when(F.col("meta.html"), F.col("description")).otherwise(escape_html("description"))
    one = joined.groupBy("source_id").agg(F.first("meta").alias("meta"), _ordered(html_item(F.col("title"), F.col("link"), shown, F.col("pub_date"))).alias("items"))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'), escape_html("meta.title"), F.lit("</title>\n</head>\n<body>\n<header>\n<h1>"), escape_html("meta.title"), F.lit("</h1>\n"))
    about = F.when(F.coalesce(F.col("meta.description"), F.lit("")) != "", F.concat(F.lit('<p class="meta">'), escape_html("meta.description"), F.lit("</p>\n"))).otherwise(F.lit(""))
    links = F.concat(F.lit('<p class="meta"><a href="'), escape_html("meta.link"), F.lit('">source</a> · <a class="rss" href="/feeds/'), escape_html("source_id"), F.lit('.xml">RSS feed</a></p>\n</header>\n<ul>\n'))
    listed = F.when(F.col("items") == "", F.lit('<li class="meta">No items yet.</li>\n')).otherwise(F.col("items"))
    made = one.select("source_id", F.concat(head, about, links, listed, F.lit("</ul>\n</body>\n</html>")).alias("body"))
    return made.withColumn("etag", content_tag("body"))


def html_index(sources: DataFrame) -> DataFrame:
    """One page that lists all feeds, a configuration-sized table."""
    entry = F.concat(
        F.lit('<li>\n<a class="item-title" href="/feeds/'), escape_html("id"), F.lit('.html">'), escape_html("meta.title"), F.lit("</a>\n"),
        F.when(F.coalesce(F.col("meta.description"), F.lit("")) != "", F.concat(F.lit('<p class="meta">'), escape_html("meta.description"), F.lit("</p>\n"))).otherwise(F.lit("")),
        F.lit('<a class="rss" href="/feeds/'), escape_html("id"), F.lit('.xml">RSS feed</a>\n</li>\n'),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("text")))), lambda x: x["text"]), "")
    return sources.agg(F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<body>\n<ul>\n'), listed, F.lit("</ul>\n</body>\n</html>")).alias("body")).withColumn("etag", content_tag("body"))


def render_feed(sources: DataFrame, items: DataFrame, source_id: str, kind: str) -> tuple[str, str] | None:
    """(body, etag) of one feed, or None for an unknown id or format: what a server answers with."""
    if kind not in ("xml", "html"):
        return None
    one, own = sources.where(F.col("id") == source_id), items.where(F.col("source_id") == source_id)
    row = (rss_feeds if kind == "xml" else html_feeds)(one, own).select("body", "etag").first()
    return tuple(row) if row else None


def feed_digests(sources: DataFrame, items: DataFrame) -> DataFrame:
    """source_id, digest: of what a feed is rendered from, in no order, by partial aggregates."""
    shown = [c for c in ("guid", "title", "link", "description", "pub_date") if c in items.columns]
    sums = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    each = items.groupBy("source_id").agg(F.concat_ws(":", F.count("*").cast("string"), sums(F.xxhash64(*shown)), sums(F.xxhash64(F.lit(1), *shown[::-1]))).alias("items"))
    joined = sources.select(F.col("id").alias("source_id"), F.xxhash64("meta").cast("string").alias("meta")).join(each, "source_id", "left")
    return joined.select("source_id", F.concat_ws("/", "meta", F.coalesce("items", F.lit("0"))).alias("digest"))


def stale_feeds(documents: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """source_id, digest of the feeds whose documents are missing or were made from other items."""
    now = feed_digests(sources, items)
    made = documents.groupBy("source_id").agg(F.min("digest").alias("was"), F.max("digest").alias("also"))
    joined = now.join(made, "source_id", "left")
    return joined.where(~(F.col("digest").eqNullSafe(F.col("was")) & F.col("digest").eqNullSafe(F.col("also")))).select("source_id", "digest")


def refreshed(documents: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """source_id, kind, digest, body, etag: the documents of all feeds, only stale ones rendered anew.

    Documents of sources that are gone go. A feed whose content is what it was keeps its tag, as that is of the content.
    """
    stale = stale_feeds(documents, sources, items)
    own = items.join(stale.select("source_id"), "source_id", "left_semi")
    asked = sources.join(stale.select(F.col("source_id").alias("id")), "id", "left_semi")
    made = rss_feeds(asked, own).withColumn("kind", F.lit("xml")).unionByName(html_feeds(asked, own).withColumn("kind", F.lit("html")))
    kept = documents.join(stale.select("source_id"), "source_id", "left_anti").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return kept.unionByName(made.join(stale, "source_id")).select("source_id", "kind", "digest", "body", "etag")
