"""Planted pages: what is text, what is boilerplate, which links there are and where they lead."""

import pytest

from tidemill.operators import pages

LONG = "this paragraph has quite enough words to be main text by itself"
PAGE = f"""<!doctype html><html lang=en><head><title>A &amp; B
 page</title><base href="/base/dir/"><style>p {{ margin: 0 }}</style><script>document.write('<a href="/no">no</a>')</script></head>
<body><header><h1>Site</h1></header><nav><a href="/one">one</a> <a href='two'>two</a></nav>
<div>short ad</div><h2>Heading</h2><p>{LONG}, <b>bold</b><a href="https://Other.Example.COM:443/x#y" rel="nofollow ugc">a <i>link</i></a>.</p><p>short one</p>
<p><a href="/l1">only link words here</a> and <a href="/l2">some more of them for the list</a></p><h3>Left alone</h3>
<!-- <a href="/comment">c</a> --><noscript><a href="/ns">x</a></noscript><div>{LONG} again<p>tail
<footer>{LONG} <a href="mailto:a@b.c">mail</a><a name=anchor>none</a></footer><map><area href="?q=1" alt="Area"></map><a href="//cdn.example.org">cdn</a><a href="http://[bad">bad</a></body>"""


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


def test_text(spark):
    rows = [(1, "http://Example.com/a/b", PAGE), (2, None, None), (3, "x", ""), (4, "x", "plain <b>text"), (5, "u", f"<p>{LONG}" * 3000), (1, "http://Example.com/a/b", PAGE)]
    got = {}
    for r in pages.texts(table(spark, rows)).collect():
        assert got.setdefault(r.page_id, r) == r
    page = got[1]
    assert (page.lang, page.title) == ("en", "A & B page")
    assert page.text.split("\n") == ["Heading", f"{LONG}, bolda link.", "short one", "Left alone", f"{LONG} again", "tail"]
    assert page.n_main == 6 and page.n_words == len(page.text.split())
    assert (got[2].title, got[2].text, got[2].n_blocks) == (None, "", 0) and got[3].text == "" and got[4].text == ""
    assert got[5].n_main == 3000
    assert pages.texts(table(spark, rows).limit(0)).collect() == []


def test_links(spark):
    rows = [(1, "http://Example.com/a/b", PAGE), (2, None, '<a href="rel">r</a><a href="https://h.example/p">p'), (3, "http://e.example", None)]
    df = table(spark, rows)
    got = [(r.page_id, r.href, r.target, r.anchor, r.nofollow) for r in pages.links(df).orderBy("page_id", "at").collect()]
    base = "http://example.com"
    assert got == [
        (1, "/one", f"{base}/one", "one", False), (1, "two", f"{base}/base/dir/two", "two", False), (1, "https://Other.Example.COM:443/x#y", "https://other.example.com/x", "a link", True),
        (1, "/l1", f"{base}/l1", "only link words here", False), (1, "/l2", f"{base}/l2", "some more of them for the list", False), (1, "mailto:a@b.c", None, "mail", False),
        (1, "?q=1", f"{base}/base/dir/?q=1", "Area", False), (1, "//cdn.example.org", "http://cdn.example.org/", "cdn", False), (1, "http://[bad", None, "bad", False),
        (2, "rel", None, "r", False), (2, "https://h.example/p", "https://h.example/p", "p", False),
    ]
    assert {r.page_id: (r.n_links, r.n_targets, r.n_internal) for r in pages.link_counts(df).collect()} == {1: (9, 7, 5), 2: (2, 1, 0), 3: (0, 0, 0)}
    graph = {(r.from_host, r.to_host): (r.n_links, r.n_pages) for r in pages.host_graph(df).collect()}
    assert graph == {("example.com", "example.com"): (5, 1), ("example.com", "other.example.com"): (1, 1), ("example.com", "cdn.example.org"): (1, 1), (None, "h.example"): (1, 1)}
    assert pages.links(df.limit(0)).collect() == [] and pages.link_counts(df.limit(0)).collect() == []


@pytest.mark.parametrize("base,href,want", [
    ("http://a.example/x/y?z", "../up#f", "http://a.example/up"), ("http://a.example", "", "http://a.example/"), ("HTTP://A.example:80/p", "q", "http://a.example/q"), ("http://a.example:8080/p", "//b.example:81", "http://b.example:81/"),
    ("http://a.example", "javascript:void(0)", None), ("not a url", "x", None), ("http://a.example", "http://b.example:port/", None), ("http://a.example", " /s p ", "http://a.example/s p"), (None, None, None), ("http://a.example", "http://[::1]/x", "http://[::1]/x"),
])
def test_targets(base, href, want):
    assert pages.target_of(base, href) == want
