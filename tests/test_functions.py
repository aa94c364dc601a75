import random

import pytest
from pyspark.sql import functions as F

from feltloom.functions import arrays, dates, text, urls
from feltloom.functions.fragments import text_of
from feltloom.functions.sanitize import clean, style_allowed


def loop_diff(a, b):
    a, b = list(a), list(b)
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return [f"- {x}" for x in a] + [f"+ {x}" for x in b]


def test_edge_diff_is_the_loop(spark):
    draw = random.Random(0)
    pairs = [([draw.choice("abc") for _ in range(draw.randint(0, 6))], [draw.choice("abc") for _ in range(draw.randint(0, 6))]) for _ in range(600)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for r in frame.select("i", arrays.edge_diff(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == loop_diff(*pairs[r.i]), pairs[r.i]


def cases():
    return [
        (text.collapse_space(F.lit("  a\t b c\u0085")), "a b c"),
        (text.slug(F.lit("  Kenny Ω vs. Okada (IV)! ")), "kenny-ω-vs-okada-iv"),
        (text.fold_name(F.lit("Ár-Tist & Co. 2")), "ártistco2"),
        (text.prose_slug(F.lit("A B"), F.lit("C!")), "ab:c"),
        (text.prose_slug(F.lit("A"), F.lit("—")), None),
        (text.clean_name(F.lit(" ,Name.; ")), "Name"),
        (text.trim_edition(F.lit("Title (Deluxe)")), "Title"),
        (text.trim_edition(F.lit("Big  Title EP")), "Big Title"),
        (text.trim_edition(F.lit("EP")), "EP"),
        (text.album_names(F.lit("Art"), F.lit("Song LP [2020]")), ["art:songlp2020", "art:songlp", "art:song"]),
        (text.tidy_lines(F.lit("\r\n a  b\r\n\n\n\nc\n ")), ["a b", "", "c"]),
        (text.plain_lines(F.lit("")), []),
        (text.plain_lines(F.lit("a\r\nb\n")), ["a", "b", ""]),
        (text.strip_marker(F.lit("/PTG/ — General"), "/ptg/"), "General"),
        (text.title_line(F.lit("Name\nfirst\nThe Edition\n>q"), "Name"), "The Edition"),
        (text.title_line(F.lit("first\n>q\nThe Edition"), "Name"), "first"),
        (text.join_titles(F.lit("Chapter 1"), F.lit("CHAPTER 1")), "Chapter 1"),
        (text.join_titles(F.lit("Chapter 1"), F.lit("Dawn")), "Chapter 1 — Dawn"),
        (text.stars(F.lit("5.25")), "5.25 stars"),
        (text.stars(F.lit("5 Stars")), "5 Stars"),
        (text.tidy_punctuation(F.lit("A , B ( C )")), "A, B (C)"),
        (text.escape_html(F.lit("<a b=\"c\">'&")), "&lt;a b=&#34;c&#34;&gt;&#39;&amp;"),
        (text.escape_xml(F.lit("a\n\t\r")), "a&#xA;&#x9;&#xD;"),
        (text.positive_id(F.lit("007")), None),
        (text.positive_id(F.lit("7")), "7"),
        (text.genre_description(F.lit("")), ""),
        (dates.italian_date(F.lit("2026-10-05").cast("date")), "5 Ott 2026"),
        (dates.rfc1123z(F.lit("2024-02-03 04:05:06").cast("timestamp")), "Sat, 03 Feb 2024 04:05:06 +0000"),
        (dates.long_date(F.lit("2024-02-03").cast("timestamp")), "3 February 2024"),
        (dates.retry_after_seconds(F.lit("120"), F.lit("2024-01-01").cast("timestamp")), 120),
        (dates.retry_after_seconds(F.lit("-5"), F.lit("2024-01-01").cast("timestamp")), 0),
        (dates.retry_after_seconds(F.lit("Mon, 01 Jan 2024 00:01:30 GMT"), F.lit("2024-01-01 00:00:00").cast("timestamp")), 90),
        (dates.retry_after_seconds(F.lit("soon"), F.lit("2024-01-01").cast("timestamp")), 0),
        (dates.civil_date(F.lit("2026-07-01 22:30:00").cast("timestamp")).cast("string"), "2026-07-02"),
        (urls.is_web(F.lit("javascript:alert(1)")), False),
        (urls.is_web(F.lit(" https://a.b/c ")), True),
        (urls.query_value(F.lit("https://a/?x=1%202&y=3"), "x"), "1 2"),
        (urls.with_query(F.lit("https://a/?page=1&z=2"), "page", F.lit(7)), "https://a/?page=7&z=2"),
        (urls.with_query(F.lit("https://a/"), "page", F.lit(2)), "https://a/?page=2"),
        (arrays.sorted_set(F.array(*map(F.lit, ["b", "", "a", "b"]))), ["a", "b"]),
        (arrays.same_set(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))), True),
        (arrays.same_set(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"))), False),
    ]


def test_values(spark):
    found = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases())]).first()
    assert [(i, got, value) for i, (got, (_, value)) in enumerate(zip(found, cases())) if got != value] == []


@pytest.mark.parametrize(
    ("fragment", "expected"),
    [
        ("<p>a<script>x</script>b</p>", "<p>ab</p>"),
        ('<img src="javascript:x"><img src="https://h/i.png" onerror="x" alt="&lt;">', '<img src="https://h/i.png" alt="&lt;">'),
        ('<a href="x">t</a><b>u</b>', "tu"),
        ('<span style="color:#fff">a</span><span style="background:url(x)">b</span>', '<span style="color:#fff">a</span><span>b</span>'),
        ("<ul><li>1<li>2</ul>", "<ul><li>1</li><li>2</li></ul>"),
        ("<p>open <em>x", "<p>open <em>x</em></p>"),
        ("1 < 2 & \"q\"", "1 &lt; 2 &amp; &#34;q&#34;"),
        ("<iframe><p>in</p></iframe>out<!-- c -->", "out"),
        ("<svg><p>x</p></svg><br/>y", "<br>y"),
    ],
)
def test_sanitizer(fragment, expected):
    assert clean(fragment) == expected


def test_styles():
    assert style_allowed("white-space:pre-wrap") and not style_allowed("x:expression(1)") and not style_allowed("é:1")


def test_fragment_texts():
    assert text_of("a<br>b &amp; c", False) == "a\nb & c"
    assert text_of('<p>one</p>see<a href="https://x/y">here</a><script>no</script>', True) == "\none\nsee here (https://x/y)"
