import random
import time

import pytest
from pyspark.sql import functions as F

from feltloom.sources import html

HOSTILE = {
    "div": "<div>x", "list": "<ul><li>", "quote": '<a "', "misnested": "<b>x</i>", "comment": "<!--", "tables": "<p><table>", "value": "<a b='c", "signs": "<", "script": "<script>", "references": "&#x", "ends": "</p></div>", "declaration": "<!x", "paragraphs": "<p>a<p>",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_grows_with_length(kind):
    def seconds(n):
        page = HOSTILE[kind] * (n // len(HOSTILE[kind]))
        best = 9e9
        for _ in range(2):
            began = time.perf_counter()
            html.parse(page)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(800_000) < 12 * seconds(200_000) + 0.5


def texts_below(nodes, pos):
    return "".join(n[7] for n in nodes[pos : nodes[pos][2] + 1] if n[4] == "text")


def made(seed):
    draw = random.Random(seed)
    parts = ["<p>", "</p>", "<div class='c'>", "</div>", "<a href=x>", "</a>", "<b>", "</b>", "é&amp;t", " x ", "<ul><li>", "</ul>", "<!-- c -->", "<br>", "<script>var a='</p>';</script>", "<", "<td>", "<table><tr>"]
    return "".join(draw.choice(parts) for _ in range(draw.randrange(60)))


def test_tree_is_sound():
    for seed in range(300):
        page = made(seed)
        nodes = html.parse(page, frozenset(("div", "p", "a", "b")))
        for pos, parent, end, depth, kind, tag, _, text in nodes:
            assert pos == nodes[pos][0] and pos <= end
            if parent >= 0:
                assert nodes[parent][0] < pos <= end <= nodes[parent][2] and nodes[parent][3] + 1 == depth
            if tag in ("div", "p", "a", "b"):
                assert text == texts_below(nodes, pos)


def test_deep_elements_stand_beside_each_other():
    nodes = html.parse("<div>x" * 2000, frozenset(("div",)))
    assert max(n[3] for n in nodes) == html.MAX_DEPTH and sum(n[5] == "div" for n in nodes) == 2000
    assert nodes[0][7] == "x" * 2000


def test_what_the_scanner_makes_of_markup():
    kinds = lambda page: [(n[4], n[5], n[6], n[7]) for n in html.parse(page)]
    assert kinds("a < b &lt; c") == [("text", None, None, "a < b < c")]
    assert kinds("a<!-- x --->b<!-- y") == [("text", None, None, "a"), ("text", None, None, "b")]
    assert kinds("<A HREF=x&amp;y href=z data-q='1' off>t</A >u") == [("element", "a", {"href": "x&y", "data-q": "1", "off": ""}, None), ("text", None, None, "t"), ("text", None, None, "u")]
    assert kinds("<script>a<b</script><title>c &amp; d</title>") == [("element", "script", {}, None), ("text", None, None, "a<b"), ("element", "title", {}, None), ("text", None, None, "c & d")]
    assert kinds("<p>a<p>b")[2][1] == "p" and html.parse("<p>a<p>b")[2][1] == -1  # the first one has ended
    assert kinds(None or "") == [] and kinds("<p") == [("element", "p", {}, None)]


def test_subtree_text_is_the_walk(spark):
    pages = [(i, made(i)) for i in range(60)] + [(60, None), (61, "")]
    nodes = html.dom_nodes(spark.createDataFrame(pages, "id long, body string"), "body", "id").persist()
    whole = {i: html.parse(body) for i, body in pages}
    roots = html.elements(nodes).where("tag in ('div', 'p', 'li', 'table')")
    got = {(r.id, r.of): r.content for r in html.subtree_text(nodes, roots, "id").collect()}
    assert got == {(i, n[0]): texts_below(ns, n[0]) for i, ns in whole.items() for n in ns if n[5] in ("div", "p", "li", "table")}
    out = {(i, p) for i, ns in whole.items() for n in ns if n[5] in ("a", "b") for p in range(n[0], n[2] + 1)}
    got = {(r.id, r.of): r.content for r in html.subtree_text(nodes, roots, "id", without=nodes.where(F.col("tag").isin("a", "b"))).collect()}
    assert got == {(i, n[0]): "".join(x[7] for x in ns[n[0] : n[2] + 1] if x[4] == "text" and (i, x[0]) not in out) for i, ns in whole.items() for n in ns if n[5] in ("div", "p", "li", "table")}
    assert "Cartesian" not in html.subtree_text(nodes, roots, "id")._jdf.queryExecution().toString() and "NestedLoop" not in html.subtree_text(nodes, roots, "id")._jdf.queryExecution().toString()
    nodes.unpersist()
