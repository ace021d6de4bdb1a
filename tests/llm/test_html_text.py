"""HTML extraction: the articles of the test pages, pages without a marked article, the alignment against a table, and odd markup."""

import random
import re
from html import unescape

import pytest

from leadloom.llm import html_text, queries


def texts(spark, rows, columns="page_id bigint, url string, html string"):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, columns)).collect()}


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1, 40, 1 << 20])
def test_common_is_longest(bits):
    rnd = random.Random(bits)
    for _ in range(300):
        a, b = ([rnd.randrange(rnd.choice([3, 8, 30])) for _ in range(rnd.randrange(30))] for _ in range(2))
        at = html_text.common(a, b, bits)
        assert at == sorted(set(at)) and len(at) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)  # in b in the same order


def test_articles_of_the_pages(spark):
    """The pages of the test data have one article element each: its blocks are the whole text, whatever the neighbour shares."""
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", article)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    rows = queries.op13_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def plain(title, story, extra=""):
    return f"<html><body><div><span>Home</span> <span>News</span></div><div>{title}</div>{''.join(f'<div>{s}</div>' for s in story)}{extra}<div>Write to the desk at any time</div><div>All rights kept</div></body></html>"


def test_nearest_page_tells_what_is_the_sites(spark):
    story = lambda n: [f"Story {n} begins here.", f"It goes on with {n} words.", "They all lived on."]
    pages = [(n, f"http://a.example/news/{n}", plain(f"Title {n}", story(n)[: 2 + n % 2])) for n in range(1, 6)] + [(9, "http://b.example/x", plain("Alone", story(9)))]
    got = texts(spark, pages)
    for n in range(1, 6):
        kept = got[n].split("\n\n")
        assert kept[:3] == [f"Title {n}", f"Story {n} begins here.", f"It goes on with {n} words."]
        assert "Home News" not in kept and "All rights kept" not in kept
    assert "Home News" in got[9]  # a host with one page has no pair


def test_nearest_is_the_longer_common_path(spark):
    pages = [(1, "http://a.example/a/b/1", ""), (2, "http://a.example/a/b/2?q=1", "x"), (3, "http://a.example/a/c/1/", "y"), (4, "http://a.example/z.html", "z"), (5, None, "n")]
    contents = html_text.contents_of(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    content = {bytes(html_text.digest(html_text.read_lines(h))): i for i, _, h in pages}
    near = {content[bytes(r.content)]: content[bytes(r.other)] for r in html_text.neighbours(contents).collect()}
    assert near == {1: 2, 2: 1, 3: 2, 4: 3}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    pages = [(n, f"http://a.example/news/{n // 3}", plain(f"Title {n}", [f"Story {n} begins.", "And so on.", f"{n} " * 40])) for n in range(30)]
    want = texts(spark, pages)
    monkeypatch.setattr(html_text, "join_checked", lambda left, right, on, how, wide: left.join(right.hint("merge"), on, how))
    assert texts(spark, pages) == want and "Home News" not in want[7]


def test_copies_and_versions_stay(spark):
    one = plain("Title", ["A long first part of the story.", *(f"Part {n} of it, with some more words in it." for n in range(8)), "A last part, as long as the first."])
    two = one.replace("Title", "Title, new").replace("as long as", "longer than")
    got = texts(spark, [(1, "http://a.example/1", one), (2, "http://a.example/2", one), (3, "http://a.example/3", two), (3, "http://a.example/3", two)])
    assert "A long first part of the story." in got[1] and got[1] == got[2] and "Title, new" in got[3]


RICH = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><a href="/">Home</a></header>
<div id="cookieNotice">We use cookies.</div><div class="site-menu"><a href=a>A</a></div><form action="/s"><input name=q><button>Go</button></form>
<article class="post"><header><h1>Head &amp; tail</h1><span>by Ann</span></header><p>First <b>bold</b> and&nbsp;<a href="x">link</a>.<br>After
 break<p>Second &lt;tag&gt; 1 < 2<script>if (a < b) { t = "</p>" }</script><aside>Aside.</aside><div class="advert">Buy!</div>
<ul><li>One<li>Two <i>2</i></ul><ul><li><a href=1>Related link</a></ul><blockquote>Quote</blockquote><div class="comments"><p>Reader says.</p></div><!-- a > b --></article>
<div class="sidebar">Side</div><footer>&copy; Site</footer><noscript>No</noscript></body></html>"""


def test_furniture_and_references(spark):
    got = texts(spark, [(1, "http://a.example/1", RICH)])[1]
    assert got.split("\n\n") == ["Head & tail", "First bold and link. After break", "Second <tag> 1 < 2", "One", "Two 2", "Quote"]


def test_form_and_class_around_the_article_are_spared(spark):
    page = '<body><form id="aspnet"><div class="search-page"><main><p>Text of it.</p></main></div><div class="ad">Ad</div></form></body>'
    alone = '<body><div class="form-page"><p>The long text that makes up the page.</p></div><div class="ad">Ad</div></body>'
    assert texts(spark, [(1, "u", page), (2, "v", alone)]) == {1: "Text of it.", 2: "The long text that makes up the page."}


def test_cases(spark):
    assert texts(spark, []) == {}
    rows = [(1, None, None), (2, "x", ""), (3, "not a url", "no tags at all "), (4, "x", "<p>open <b>tags"), (5, "x", '<p>a</p><a href="never closed>b</a><p>c'), (6, "x", "<p>a<!-- open <p>b"), (7, "x", "a </p> b </nav> c"), (None, "x", "<p>no id")]
    assert texts(spark, rows) == {1: "", 2: "", 3: "no tags at all", 4: "open tags", 5: "a", 6: "a", 7: "a\n\nb\n\nc", None: "no id"}
    long = "<div>" * 20_000 + "deep " + "<p>word " * 50_000 + "<" * 5000
    got = html_text.extract(spark.createDataFrame([(1, "u", long, 5, "z"), (1, "u", long, 5, "z")], "page_id bigint, url string, html string, Host int, lines string")).collect()
    assert len(got) == 2 and got[0].n_lines == 50_001 and got[0].n_chars == len(got[0].text)
