"""Change feeds: what differs between consecutive complete observations, numbered by revision.

The first observation is a silent baseline; so is the first under another extraction version. A
revision counts the polls that changed something. Comparison is by a full outer join of an epoch with
the one before on (source, guid): both sides are hashed the same way, so it is one shuffle of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltloom.functions.arrays import edge_diff, let
from feltloom.functions.text import escape_html

# The sections of a recommendation, in the order they are shown.
SECTIONS = ["Best", "Alt", "Unmuxed Best", "Notes", "Tags", "Dual Audio", "Incomplete", "Comparisons", "Releases"]


def compare(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, kind (added, removed, updated), old, new."""
    old, new = before.select(*keys, F.col(value).alias("old"), F.lit(True).alias("was")), after.select(*keys, F.col(value).alias("new"), F.lit(True).alias("is"))
    both = old.join(new, keys, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", "old", "new")


def successive(epochs: DataFrame) -> DataFrame:
    """Complete epochs of each source, numbered densely, and whether each can be compared with the one before."""
    order = Window.partitionBy("source_id").orderBy("epoch")
    return epochs.withColumn("n", F.row_number().over(order)).withColumn("comparable", F.coalesce(F.col("version") == F.lag("version").over(order), F.lit(False)))


def change_events(observed: DataFrame, epochs: DataFrame, value: str = "metadata") -> DataFrame:
    """source_id, epoch, guid, kind, old, new over all epochs. ``epochs``: source_id, epoch, version of complete ones."""
    numbered = successive(epochs)
    rows = observed.join(numbered.select("source_id", "epoch", "n"), ["source_id", "epoch"]).select("source_id", "n", "guid", value)
    last = numbered.groupBy("source_id").agg(F.max("n").alias("last"))
    earlier = rows.join(last, "source_id").where("n < last").select("source_id", (F.col("n") + 1).alias("n"), "guid", value)
    found = compare(earlier, rows, ["source_id", "n", "guid"], value)
    return found.join(numbered.where("comparable").select("source_id", "n", "epoch"), ["source_id", "n"]).drop("n")


def revisions(events: DataFrame) -> DataFrame:
    """Events with their revision (polls of the source with a change, up to this) and guid ``source:revision:entity``."""
    changed = events.select("source_id", "epoch").distinct().withColumn("revision", F.row_number().over(Window.partitionBy("source_id").orderBy("epoch")))
    return events.join(changed, ["source_id", "epoch"]).withColumn("event_guid", F.concat_ws(":", F.col("source_id").cast("string"), F.col("revision").cast("string"), F.col("guid").cast("string")))


def in_page_order(events: DataFrame) -> list[Column]:
    """Order: what is on the page as it stands there, then removed entities by id as text."""
    gone = F.col("kind") == "removed"
    return [gone.asc(), F.when(~gone, F.col("ord")).asc(), F.when(gone, F.col("guid")).asc()]


def numeric_order(guid: str = "guid") -> list[Column]:
    return [F.col(guid).cast("bigint").asc()]


#: What removed and added lines look like.
GONE, NEW = "#b42318", "#067647"


def _section(name: str):
    return lambda lines: F.when(F.size(lines) > 0, F.concat(F.lit(f'<h3>{name}</h3><pre style="white-space:pre-wrap">'), F.array_join(lines, "\n"), F.lit("</pre>")))


def render_sections(old: Column, new: Column) -> Column:
    """HTML of the sections that differ between two structs of string arrays; empty if none does."""
    parts = []
    for name in SECTIONS:
        field = name.lower().replace(" ", "_")
        before, after = (F.coalesce(x[field], F.array().cast("array<string>")) for x in (old, new))
        colour = lambda line: F.when(line.startswith("+ "), F.lit(NEW)).otherwise(F.lit(GONE))
        shown = F.transform(edge_diff(before, after), lambda x: F.concat(F.lit('<span style="color:'), colour(x), F.lit('">'), escape_html(x), F.lit("</span>")))
        parts.append(let(shown, _section(name)))
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n\n")


def render_notes(notice: str, notes: Column) -> Column:
    """A notice, and the notes below it if there are any."""
    body = F.concat(F.lit('<h3>Notes</h3><pre style="white-space:pre-wrap">'), F.array_join(F.transform(notes, escape_html), "\n"), F.lit("</pre>"))
    return F.concat(F.lit(f"<p>{notice}</p>"), F.when(F.size(notes) > 0, body).otherwise(F.lit("")))


def render_note_diff(old: Column, new: Column) -> Column:
    lines = F.transform(edge_diff(old, new), escape_html)
    body = let(lines, lambda x: F.when(F.size(x) > 0, F.concat(F.lit('<pre style="white-space:pre-wrap">'), F.array_join(x, "\n"), F.lit("</pre>"))).otherwise(F.lit("")))
    return F.concat(F.lit("<p>Notes changed.</p>"), body)


def stack_events(events: DataFrame, link: str) -> DataFrame:
    """Membership and note events of a curated list; old and new are structs of title and notes."""
    shown = F.coalesce(F.col("new.title"), F.col("old.title"))
    label = F.when(F.col("kind") == "added", "Added: ").when(F.col("kind") == "removed", "Removed: ").otherwise("Notes updated: ")
    said = (
        F.when(F.col("kind") == "added", render_notes("Added to the stack.", F.col("new.notes")))
        .when(F.col("kind") == "removed", render_notes("Removed from the stack.", F.col("old.notes")))
        .otherwise(render_note_diff(F.col("old.notes"), F.col("new.notes")))
    )
    changed = events.where((F.col("kind") != "updated") | ~F.col("old.notes").eqNullSafe(F.col("new.notes")))
    rest = [c for c in events.columns if c not in ("old", "new", "title", "link", "description")]
    return changed.select(*rest, F.concat(label, shown).alias("title"), F.concat(F.lit(link), "guid").alias("link"), said.alias("description"))


def section_events(events: DataFrame) -> DataFrame:
    """Events of entities whose sections differ; one without a difference is none, even if it came or went."""
    return events.withColumn("description", render_sections(F.col("old"), F.col("new"))).where("description <> ''")


#: A recommendation's sections as they are saved.
SAVED_SECTIONS = f"struct<{','.join(s.lower().replace(' ', '_') + ':array<string>' for s in SECTIONS)}>"
STACK_LINK = "https://myanimelist.net/anime/"


def shown(events: DataFrame) -> DataFrame:
    """source_id, epoch, guid, kind, title, link, description, metadata: what a feed shows of events.

    ``old`` and ``new`` are structs of title, link and metadata (saved JSON), null on the side that has no such entity.
    Recommendations show the sections that differ, stacks their notes, any other source the kind; what shows nothing is no event.
    """
    columns = ["source_id", "epoch", "guid", "kind", "title", "link", "description", "metadata"]
    either = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))
    each = events.withColumn("metadata", F.to_json(F.struct(F.col("old.metadata").alias("old"), F.col("new.metadata").alias("new"))))
    saved = lambda c, schema: F.from_json(F.col(f"{c}.metadata"), schema)
    is_sections, is_stack = F.col("source_id") == "seadex", F.col("source_id").startswith("mal-stack-")
    sections = each.where(is_sections).withColumns({"title": either("title"), "link": either("link"), "old": saved("old", SAVED_SECTIONS), "new": saved("new", SAVED_SECTIONS)})
    card = lambda c: F.struct(F.col(f"{c}.title").alias("title"), F.coalesce(saved(c, "struct<notes:array<string>>")["notes"], F.array().cast("array<string>")).alias("notes"))
    stacks = each.where(is_stack).withColumns({"old": card("old"), "new": card("new")})
    plain = each.where(~is_sections & ~is_stack).withColumns({"title": F.col("kind"), "link": either("link"), "description": F.lit("")})
    return section_events(sections).select(*columns).unionByName(stack_events(stacks, STACK_LINK).select(*columns)).unionByName(plain.select(*columns))
