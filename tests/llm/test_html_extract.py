import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from feltloom.llm.html_extract import HEADINGS, HOLDERS, LISTS, PARTS, RECORDS, alone, extract, host_of, main_text, read, tags

SCHEMA = "page_id long, url string, html string, text string"
PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head&eacute;r {i}</h1><p><b>Bold one.<br><p>Text  of
page {i} &amp; more&nbsp;text</p><aside>side</aside><ul><li>one<li>two</ul><div class="comments"><p>reader</p></div><form>f<input></form></article>
<div id="cookie-notice">We use cookies</div><footer>&copy; all</footer>{end}"""
WANTED = "Headér {i}\n\nBold one.\n\nText of page {i} & more text\n\none\n\ntwo"


def test_pages(spark):
    rows = [(i, f"https://h{i % 3}.example.com/x/{i}?q", PAGE.format(i=i, end="</body></html>" if i % 2 else ""), "clash") for i in range(20)]
    for most in (0, 8 << 20):  # joined, broadcast
        got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, SCHEMA), broadcast_bytes=most).collect()}
        for i, url, *_ in rows:
            assert got[i].text == WANTED.format(i=i) and got[i].n_chars == len(got[i].text) and got[i].url == url


def test_sites_without_an_article_element(spark):
    page = '<html><body><div class="top"><a href="/">Home</a> <a href="/x">All</a></div><div class="c"><div class="body"><p>Story {i} begins with words.</p><p>And goes on {i}.</p></div></div><div class="end">Same end line everywhere on this site, quite long.</div></body></html>'
    rows = [(i, "http://one.example/a", page.format(i=i * 7919), None) for i in range(9)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Story {i * 7919} begins with words.\n\nAnd goes on {i * 7919}." for i in range(9)}


def test_nulls_empties_repeats_and_broken_markup(spark):
    rows = [(1, None, None, None), (None, "http://a/", "", "x"), (2, "no url", "<div>plain < text & more</div>", None), (3, "http://b/", "<article><p>x<!-- open", None), (3, "http://b/", "<article><p>x<!-- open", None), (4, "http://b/", '<p><a title="open>z</a></p>' * 3, None), (5, None, "<article>" + "<div>" * 3000 + "deep" + "</div>" * 10, None)]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    found = {r[0]: r[2] for r in got}
    assert found[1] == "" and found[None] == "" and found[2] == "plain < text & more" and found[3] == "x" and found[5] == "deep"
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []


class Tree(HTMLParser):
    """Plain trees of well-formed pages: nodes are [chain, tag, children or texts]."""

    def __init__(self, page):
        super().__init__()
        self.top = ["", "", []]
        self.stack = [self.top]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [f"{self.stack[-1][0]}/{tag}.{dict(attrs).get('class', '')}", tag, []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][2].append(" ".join(data.split()))


def nodes(node):
    yield node
    for c in node[2]:
        if not isinstance(c, str):
            yield from nodes(c)


def said(node, linked=None):
    """Texts under a node; linked: only those in (True) or outside (False) links."""
    out = []
    for c in node[2]:
        if isinstance(c, str):
            out += [c] if linked is None or linked == (node[1] == "a") else []
        elif c[1] not in ("nav", "footer", "head"):
            out += said(c, linked)
    return out


def brute(pages):
    """The texts of a host's pages, by vectors and classes held whole. No page of these is alone with its layout."""
    trees, n = [Tree(p).top for p in pages], len(pages)
    found = [defaultdict(list) for _ in trees]
    for tree, own in zip(trees, found):
        for x in nodes(tree):
            own[x[0]].append(x)
    vector = {c: tuple(len(own.get(c, ())) for own in found) for own in found for c in own}
    vector = {c: v for c, v in vector.items() if 2 * sum(k > 0 for k in v) >= n}
    one = {c: next(own[c][0] for own in found if c in own) for c in vector}
    parent = {c: c.rpartition("/")[0] for c in vector}
    prose = {c: sum(len(t) for own in found for x in own.get(c, ()) for t in said(x, False)) for c in vector}
    links = {c: sum(len(t) for own in found for x in own.get(c, ()) for t in said(x, True)) for c in vector}
    texts = {c: {repr([said(x) for x in own[c]]) for own in found if c in own} for c in vector}
    varies = any(len(t) > 1 for t in texts.values())
    same = {c: varies and sum(k > 0 for k in vector[c]) > 1 and len(texts[c]) == 1 for c in vector}
    inner = lambda c: [d for d in vector if d and parent[d] == c]

    def open_(c):
        if same[c] or one[c][1] in ("nav", "footer", "head"):
            return 0
        below = [d for d in inner(c) if one[d][1] not in ("nav", "footer", "head")]
        return prose[c] - sum(prose[d] for d in below) + sum(map(open_, below))

    way = [""]
    while True:
        fits = [c for c in inner(way[-1]) if one[c][1] in HOLDERS and max(vector[c]) == 1]
        best = max(fits, key=open_, default=None)
        if best is None or not open_(best) or 2 * open_(best) < open_(way[-1]):
            break
        way.append(best)
    kept = {way[-1]} | {h for a, b in zip(way, way[1:]) for h in inner(a) if one[h][1] in HEADINGS and max(vector[h]) == 1 and not same[h]}

    def gone(c):
        own = [d for d in vector if vector[d] == vector[c] and d.startswith(c + "/") and any(isinstance(t, str) for own in found for x in own.get(d, ()) for t in x[2]) and one[d][1] != "a"]
        if one[c][1] in RECORDS and max(vector[c]) > 1 and len(own) > 1 and not any(one[d][1] in ("h1", "h2", "h3") for d in own) and 2 * prose[c] < prose[way[-1]]:
            return True
        return one[c][1] in PARTS and same[c] or one[c][1] in LISTS and n > 2 and 10 * sum(vector[c]) >= 9 * n and max(vector[c]) == 1 and 5 * links[c] >= 4 * (links[c] + prose[c]) > 0

    def texts_of(node, inside):
        inside = inside or node[0] in kept
        if node[1] in ("nav", "footer", "head") or node[0] in vector and node[0].startswith(way[-1] + "/") and gone(node[0]):
            return []
        return [t for c in node[2] for t in (([c] if inside else []) if isinstance(c, str) else texts_of(c, inside))]

    return ["\n\n".join(texts_of(t, False)) for t in trees]


def made_site(draw, article="div"):
    """Pages with scrambled class names, the same on all pages of the site."""
    some = [f"c{draw.randrange(10**9):x}" for _ in range(12)]
    some = ["".join(c for c in s if not c.isdigit()) + chr(97 + i) for i, s in enumerate(some)]
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    pages, texts = [], []
    comments, notice, inner_heading = draw.random() < 0.7, draw.random() < 0.7, draw.random() < 0.5
    for _ in range(draw.randrange(5, 12)):
        title, body = words(5), [words(draw.randrange(8, 40)) for _ in range(draw.randrange(2, 6))]
        heading, place = f"<h1>{title}</h1>", "" if inner_heading else f"<h1>{title}</h1>"
        page = f"<html><head><title>{title}</title></head><body><nav><a>menu</a></nav><div class='{some[0]}'>{words(3)}</div>{place}<{article} class='{some[1]}'>{heading if inner_heading else ''}"
        page += f"<div class='{some[2]}'>Same words on every page of it.</div>" * notice
        page += "".join(f"<p>{b}</p>" for b in body) + f"<ul class='{some[3]}'><li><a>{words(2)}</a></li><li><a>{words(2)}</a></li></ul>"
        page += f"<div class='{some[4]}'>" + "".join(f"<div class='{some[5]}'><p class='{some[6]}'>{words(1)}</p><p class='{some[7]}'>{words(2)}</p></div>" for _ in range(draw.randrange(1, 4))) + "</div>" if comments else ""
        pages.append(page + f"</{article}><footer>{words(2)}</footer></body></html>")
        texts.append("\n\n".join([title, *body]))
    return pages, texts


@pytest.mark.parametrize("article", ["div", "article"])
def test_templates_match_brute_force_whatever_the_class_names(spark, article):
    draw = random.Random(3)
    rows, wanted = [], {}
    for site in range(14):
        pages, texts = made_site(draw, article)
        assert brute(pages) == texts
        for p, t in zip(pages, texts):
            wanted[len(rows)] = t
            rows.append((len(rows), f"http://s{site}.example/", p, None))
    for most in (0, 8 << 20):
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA), broadcast_bytes=most).collect()}
        assert got == wanted
    # Without the templates, notices and comments of a page cannot be told from its text.
    assert sum(extract(r[2], frozenset(), frozenset()) != wanted[r[0]] for r in rows) > len(rows) / 3


def test_a_page_without_its_hosts_article_is_judged_alone(spark):
    draw = random.Random(5)
    pages, texts = made_site(draw)
    rows = [(i, "http://a.example/", p, None) for i, p in enumerate(pages)] + [(99, "http://a.example/", "<main><h1>Other</h1><p>layout of a page</p></main>", None)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[99] == "Other\n\nlayout of a page" and [got[i] for i in range(len(texts))] == texts


def test_one_page_of_a_host_leans_on_the_average_page(spark):
    page = "<html><body><div class='x'>{a}</div><article><h1>{t}</h1><p>{b}</p></article></body></html>"
    rows = [(i, f"http://h{i}.example/", page.format(a="An advert of nine words that stands before it.", t=f"Title {i}", b="word " * (2 if i == 7 else 60)), None) for i in range(12)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[7] == "Title 7\n\nword word"


HOSTILE = ["<script", '<a "', "<ul><li>", '<a b="', "<p>x", "<", "<!--", "<div></p>", "<table><tr><td>", "<title>", "<a =", "</", "<div hidden>", "&#x26;", "<b>", "<a b='\" ", "<div><h1>x</h1><p>y"]


@pytest.mark.parametrize("part", HOSTILE)
def test_time_grows_with_length(part):
    def seconds(size):
        page, best = part * (size // len(part)), 1e9
        for _ in range(2):
            began = time.process_time()
            extract(page, frozenset(), frozenset())
            best = min(best, time.process_time() - began)
        return best

    small, large = seconds(40_000), seconds(320_000)
    assert large < 24 * small + 0.2


def test_a_long_page():
    page = "<html><body><div>ad</div><article>" + "<p>some words of it</p>" * 40_000 + "</article></body></html>"
    assert extract(page, frozenset(), frozenset()) == "\n\n".join(["some words of it"] * 40_000)


def test_read_and_hosts():
    page = "<div>a<p>b<a href=x>link</a> c<div>d</div>e</div>"
    assert read(page, frozenset([0]))[0] == ["a", "blink c", "d", "e"]
    seen = read(page)[1]
    assert Counter((s.tag, s.own, s.links) for s in seen.values()) == Counter({("", 0, 4): 1, ("div", 2, 4): 1, ("p", 3, 4): 1, ("a", 0, 0): 1, ("div", 1, 0): 1})
    assert [host_of(u) for u in ("HTTP://A.b:80/x", "//c/d", "x", None)] == ["a.b", "c", "", ""]
    assert [(k, t) for k, t, _ in tags("<A x='>'>1<!-- <b> -->2</a ><br/>")] == [("start", "a"), ("text", ""), ("text", ""), ("end", "a"), ("start", "br")]
    assert read("<article><header><h1>T</h1><p>by</p></header><p>x</p></article>", *alone("<article><header><h1>T</h1><p>by</p></header><p>x</p></article>"))[0] == ["T", "x"]


WORDS = "some words of the article that go on for a while and say what it is about " * 4


def alone_text(page):
    return extract(page, frozenset(), frozenset())


def test_sections_of_an_article_stay(spark):
    page = "<html><body><nav><a href=/>menu</a></nav><article><h1>T{k}</h1><p>" + WORDS * 3 + "</p>" + "".join(f"<section><h2>Part {i} of {{k}}</h2><p>short {i} of {{k}}</p></section>" for i in range(3)) + "</article></body></html>"
    wanted = lambda k: "\n\n".join([f"T{k}", (WORDS * 3).strip(), *[x for i in range(3) for x in (f"Part {i} of {k}", f"short {i} of {k}")]])
    assert alone_text(page.format(k=1)) == wanted(1)
    rows = [(k, "http://a.example/", page.format(k=k), None) for k in range(6)]
    assert {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: wanted(k) for k in range(6)}


def test_a_list_of_sources_stays_unless_every_page_has_one(spark):
    page = lambda k, ul: f"<html><body><article><h1>T{k}</h1><p>{WORDS}{k}</p>{ul}</article></body></html>"
    sources = "<p>Sources:</p><ul>" + "".join(f"<li><a href=/b{i}>Book number {i}</a></li>" for i in range(5)) + "</ul>"
    assert alone_text(page(1, sources)).endswith("Sources:\n\n" + "\n\n".join(f"Book number {i}" for i in range(5)))
    related = lambda k: f"<ul><li><a href=/x>Other {k}</a></li><li><a href=/y>More {k}</a></li></ul>"
    rows = [(k, "http://a.example/", page(k, related(k)), None) for k in range(6)] + [(k, "http://b.example/", page(k, sources if k % 2 else ""), None) for k in range(6, 12)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any("Other" in got[k] for k in range(6)) and all(("Book number 4" in got[k]) == (k % 2 == 1) for k in range(6, 12))


def test_a_form_around_the_page_is_read():
    page = f"<html><body><form action=x><input type=hidden name=s><header>top</header><article><h1>T</h1><p>{WORDS}</p></article><footer>end</footer></form></body></html>"
    assert alone_text(page) == f"T\n\n{WORDS.strip()}"
    asked = f"<html><body><article><h1>T</h1><p>{WORDS}</p><form><p>Subscribe to our letter</p><input></form></article></body></html>"
    assert alone_text(asked) == f"T\n\n{WORDS.strip()}"
    assert alone_text("<html><body><!-- <form> --><form><p>ask</p></form><div><h1>T</h1><p>" + WORDS + "</p></div></body></html>") == f"T\n\n{WORDS.strip()}"
