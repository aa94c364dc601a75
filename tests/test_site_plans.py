"""How the sites' extractors go over their pages: findings 1, 2 and 5 to 10 of round 3."""

import re

import pytest
from pyspark.sql import functions as F

from feltloom.plans import flows, sites  # noqa: F401
from feltloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["films", "screenings", "stack", "matches", "essays", "chapters", "releases"])
def test_a_site_reads_each_page_once(spark, name):
    """No shuffle of a page's nodes: one Python pass over the pages, and no join."""
    plan = QUERIES[f"site_{name}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("site_")])
def test_lines_meet_before_they_are_markup(spark, name):
    """What is shuffled to a page are a line's columns, not its far wider markup."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "collect_list" in line)
    collected = re.search(r"collect_list\(struct\((.*?)\)", grouped)[1]
    assert all(re.fullmatch(r"l_\w+(#\d+L?)?", column) for column in collected.split(", "))


def test_selections_on_odd_pages(spark):
    rows = lambda body, of: [tuple(r) for r in of(spark.createDataFrame([("s", 1, body), ("s", 2, None), ("s", 3, "")], "source_id string, epoch long, body string")).select("guid", F.btrim("title")).collect()]
    film = '<!-- c --><article class="x type-films"><b class=\'entry-title\'>t</b><h2 class="entry-title"><a href="/films/no/">n</a></h2></article>'
    assert rows(film, flows.films) == []  # the first title has no anchor
    assert rows(film.replace("<b class='entry-title'>t</b>", ""), flows.films) == [("visionario:film:no", "n")]
    seen = '<div class="a properties"><a href="https://www.cine-cittafiera.com/scheda-film/?id_pro=1">in</a></div><a href="https://www.cine-cittafiera.com/scheda-film/?id_pro=2">o<i class=properties>x</i>ut</a>'
    assert rows(seen, flows.screenings) == [("citta-fiera:film:2", "out")]


def test_a_chapter_is_told_without_casts_that_fail(spark):
    """F8: texts without a number were cast, an exception each. Numbers count as numbers, leading zeros or not; none, 0 and 2^31 are none."""
    pages = lambda *divs: spark.createDataFrame([("s", 1, f'<a href="/chapters/1/one-piece-chapter-{n}">' + "".join(f"<div>{d}</div>" for d in said) + "</a>") for n, *said in divs], "source_id string, epoch long, body string")
    found = flows.chapters(pages((7, "x", "One CHAPTER  007 ", "y"), (8, "Chapter 80", "z"), (0, "Chapter 0"), (2**31, f"Chapter {2**31}"), ("009", "Chapter 9"), (10, "a Chapter 1 Chapter 10")))
    assert sorted(tuple(r) for r in found.select("guid", "title").collect()) == [("one-piece:chapter:7", "One CHAPTER 007 — y"), ("one-piece:chapter:9", "Chapter 9")]
    named = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "chapter\\s+" in line)
    assert "try_cast" not in named and found._jdf.queryExecution().optimizedPlan().toString().count("chapter\\s+") == 1


def test_a_thread_is_tidied_once(spark):
    """the tidied comment stood in the plan anew for each use of it."""
    pages = spark.createDataFrame([("s", 1, '[{"page":1,"threads":[{"no":3,"sub":"/PTG/ - x","com":" a <br>b &amp; c","time":9},{"no":4,"sub":"/ptg/","com":" <br> ","time":9},{"no":5,"sub":"/ptg/","com":"Old edition","time":9},{"no":6,"sub":null,"com":"d","time":9}]}]')], "source_id string, epoch long, body string")
    found = flows.catalog(pages, "ptg")
    assert sorted(tuple(r) for r in found.select("guid", "title", "description").collect()) == [("ptg:3", "x", "a\nb & c"), ("ptg:5", "Private Trackers General — Old edition", "Old edition")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("x{0085}") == 2  # white space of the comment's lines and of those that may be a title
