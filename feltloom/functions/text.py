"""Text normalisation as Column functions: they stay in the JVM and fold into the scan's projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, which Java's \s and trim() cover only in part.
SPACE = r"[\s\p{Z}\x{0085}\x{000B}]"
ITALIAN_MONTHS = "Gen Feb Mar Apr Mag Giu Lug Ago Set Ott Nov Dic".split()
EDITION_MARKS = " ,;:."


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_space(x: Column | str) -> Column:
    """One space for each run of Unicode white space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), SPACE + "+", " "))


def slug(x: Column | str) -> Column:
    """Lower-case letters and digits, everything else one dash, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))


def fold_name(x: Column | str) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{Nd}]+", "")


def prose_slug(artist: Column | str, title: Column | str) -> Column:
    """``artist:title``; null unless both have a letter or digit."""
    a, t = fold_name(artist), fold_name(title)
    return F.when((a != "") & (t != ""), F.concat_ws(":", a, t))


def clean_name(x: Column | str) -> Column:
    return F.btrim(_c(x), F.lit(EDITION_MARKS))


def trim_edition(x: Column | str) -> Column:
    """A title without one trailing bracketed part, or one trailing format word."""
    t = F.trim(_c(x))
    bracketed = F.regexp_extract(t, r"(?s)^(.+)(?:\([^(]*\)|\[[^\[]*\])$", 1)
    word = F.regexp_extract(t, r"(?is)^(.*\S)\s+(?:ep|lp|single|e\.p\.)$", 1)
    return F.when(t.rlike(r"(?s)^.+(?:\([^(]*\)|\[[^\[]*\])$"), F.trim(bracketed)).when(word != "", collapse_space(word)).otherwise(t)


def album_names(artist: Column | str, title: Column | str) -> Column:
    """``artist:title`` of a title and of what is left as its edition marks go, one at a time until none is left.

    A mark takes a bracket or a space with it, so there are no more steps than the title has of these.
    """
    text = F.coalesce(_c(title), F.lit(""))
    less = lambda t: F.regexp_replace(clean_name(trim_edition(t)), "[ \\-\u2013\u2014]+$", "")
    steps = F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"[(\[\s]")))
    titles = F.aggregate(steps, F.array_append(F.array().cast("array<string>"), text), lambda done, _: F.array_append(done, less(F.element_at(done, -1))))
    return F.array_distinct(F.filter(F.transform(titles, lambda t: prose_slug(artist, t)), lambda n: n.isNotNull()))


def unix_lines(x: Column | str) -> Column:
    return F.replace(F.replace(_c(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def plain_lines(x: Column | str) -> Column:
    """Lines of a text with CRLF or LF ends; none of an empty text."""
    text = F.coalesce(_c(x), F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"))


def tidy_lines(x: Column | str) -> Column:
    """Trimmed lines: inner white space collapsed, runs of blank lines made one, none at the ends."""
    trimmed = F.transform(F.split(unix_lines(F.coalesce(_c(x), F.lit(""))), "\n"), lambda v: collapse_space(v))
    single = F.element_at(F.transform(F.array(trimmed), lambda a: F.filter(a, lambda v, i: (v != "") | ((i > 0) & (F.get(a, i - 1) != "")))), 1)
    return F.element_at(F.transform(F.array(single), lambda a: F.when(F.get(a, F.size(a) - 1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)), 1)


def tidy_text(x: Column | str) -> Column:
    return F.array_join(tidy_lines(x), "\n")


def strip_marker(subject: Column | str, marker: str) -> Column:
    """A thread's name without the first marker (any case) and the dashes before what follows it."""
    found = F.regexp_replace(_c(subject), rf"(?is)^(.*?)\Q{marker}\E", "$1")
    return F.when(F.lower(_c(subject)).contains(marker), F.btrim(F.regexp_replace(found, "^[ \\-\u2013\u2014\t]+", ""))).otherwise(F.btrim(_c(subject)))


def title_line(text: Column | str, name: str = "", marker: str = "") -> Column:
    """Of the lines before the first quotation, but those that only say ``name``: the first that tells an edition, else the first."""
    lines = plain_lines(text)
    if marker:
        lines = F.transform(lines, lambda v: strip_marker(v, marker))
    kept = F.filter(F.transform(lines, lambda v: collapse_space(v)), lambda v: (v != "") & (fold_name(v) != fold_name(F.lit(name)) if name else F.lit(True)))

    def pick(a: Column) -> Column:
        quoted = F.array_position(F.transform(a, lambda v: v.startswith(">")), True)
        before = F.when(quoted > 0, F.slice(a, F.lit(1), (quoted - 1).cast("int"))).otherwise(a)
        edition = F.filter(before, lambda v: F.lower(v).contains("dition"))
        return F.coalesce(F.get(edition, F.lit(0)), F.get(before, F.lit(0)), F.lit(""))

    return F.element_at(F.transform(F.array(kept), pick), 1)


def join_parts(*parts: Column | str, by: str = " · ") -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(_c(p), F.lit("")) for p in parts]), lambda p: p != ""), by)


def join_titles(heading: Column | str, subtitle: Column | str) -> Column:
    """Heading and subtitle, but the heading alone if they say the same."""
    h, s = _c(heading), F.coalesce(_c(subtitle), F.lit(""))
    return F.when((s == "") | (F.lower(h) == F.lower(s)), h).otherwise(F.concat(h, F.lit(" \u2014 "), s))


def stars(rating: Column | str) -> Column:
    r = _c(rating)
    return F.when((r == "") | F.lower(r).contains("star"), r).otherwise(F.concat(r, F.lit(" stars")))


def labelled(text: Column | str, label: str) -> Column:
    """What follows ``label:`` in a text, or an empty string."""
    return collapse_space(F.regexp_extract(_c(text), rf"(?is)^\s*{label}\s*:?\s*(.*)$", 1))


def tidy_punctuation(x: Column | str) -> Column:
    """No space before a comma or inside round brackets."""
    text = collapse_space(x)
    for wide, narrow in ((" ,", ","), ("( ", "("), (" )", ")")):
        text = F.replace(text, F.lit(wide), F.lit(narrow))
    return text


def genre_description(genre: Column | str) -> Column:
    return F.when(F.coalesce(_c(genre), F.lit("")) != "", F.concat(F.lit("Genre: "), _c(genre))).otherwise(F.lit(""))


def escape_html(x: Column | str) -> Column:
    text = _c(x)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_xml(x: Column | str) -> Column:
    """As ``escape_html``, and the white space that attribute-safe XML writers escape."""
    text = escape_html(x)
    for plain, entity in (("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def content_tag(body: Column | str) -> Column:
    """A strong validator: the first 16 bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(_c(body).cast("binary"), 256), 1, 32)


def positive_id(x: Column | str) -> Column:
    """A canonical positive 64-bit id as text, or null."""
    value = _c(x).try_cast("bigint")
    return F.when((value > 0) & (value.cast("string") == _c(x)), value.cast("string"))


def last_match(x: Column | str, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, or null."""
    return F.try_element_at(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(group)), F.lit(-1))


def version_parts(x: Column | str) -> Column:
    """``v1.2.3`` as a struct that compares like the version; null for anything else."""
    parts = F.split(F.regexp_extract(_c(x), r"^v?(\d+\.\d+\.\d+)$", 1), r"\.")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.when(_c(x).rlike(r"^v?\d+\.\d+\.\d+$"), F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch")))
