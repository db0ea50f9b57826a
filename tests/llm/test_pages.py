"""Page extraction: the consensus path, boilerplate, odd markup, edges."""

from collections import Counter

from pyspark.sql import functions as F

from ridgeline.llm import html, queries

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="page-{k}">
<header><p>Site head</p></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>gone</p> -->
<div class="content c{k}"><h2>Title {k} &amp; more</h2><p>First   para<br>line {k} <b>bold</b><p>Second &lt;x&gt; caf&eacute; a < b</p>
<div class=ad><p>Buy now, a very long advert that tries to be the main text of this page, again and again</p></div>
<ul><li>one<li>two</ul></div><aside><p>side</p></aside><div id="comments"><p>A reader says much, much more than the article itself does, on and on and on, without any end at all, really.</p></div>
<form><p>mail</p><input><button>send</button></form><div role="alert">Notice!</div><div style="display: none">hidden</div><footer>&copy; foot</footer></body></html>"""


def test_one_page():
    page = html.Page(SITE.format(k=7))
    assert page.best()[0] == ">html>body.page-0>div.c0.content"
    assert page.text([]) == "Title 7 & more\n\nFirst para line 7 bold\n\nSecond <x> café a < b\n\none\n\ntwo"


def test_consensus_outvotes_an_odd_page(spark):
    odd = SITE.format(k=9).replace("<aside><p>side</p></aside>", "<div class=extra><p>" + "quoted press release " * 60 + "</p></div>")
    rows = [(k, f"https://Site.example/{k}", SITE.format(k=k)) for k in range(8)] + [(8, "https://site.example/x", odd), (9, None, None), (None, "bad", "plain text, no tag"), (11, "http://u:p@other.example:80/", "<p>open <p>more</p"), (12, "http://e.example", "")]
    pages = spark.createDataFrame(rows + rows[:1], "page_id bigint, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("t"), "ranked": F.lit("r"), "n_chars": F.lit(0)})
    got = html.extract(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows + rows[:1])
    by = {r.page_id: r for r in got}
    assert by[8].text.startswith("Title 9 & more") and "press release" not in by[8].text
    assert by[9].text == "" and by[12].text == "" and by[None].text == "plain text, no tag" and by[11].text == "open\n\nmore"
    assert by[11].host == "other.example" and all(r.n_chars == len(r.text) for r in got)
    found = {(r.host, r.path): r.votes for r in html.votes(pages).collect()}
    assert found["site.example", ">html>body.page-0>div.c0.content"] == 9
    assert html.extract(pages.limit(0)).count() == 0


def test_text_at_several_depths_is_whole(spark):
    nested = "<html><body><nav><a href=/>Home</a></nav><div id=w><article><h1>Title {k}</h1><p>A lead of some words</p><div class=body><div><p>{long}</p></div></div></article></div><div class=list><p><a href=/a>One more story to read</a></p></div></body></html>"
    parts = "<html><body><main><section class=intro><p>Intro {k}</p></section><section class=story><p>{long}</p></section><section class=end><div><p>The end</p></div></section></main></body></html>"
    long = "many words of the story " * 20
    rows = [(k, f"http://nested.example/{k}", nested.format(k=k, long=long)) for k in range(3)] + [(k, f"http://parts.example/{k}", parts.format(k=k, long=long)) for k in range(3, 6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = {k: f"Title {k}\n\nA lead of some words\n\n{long.strip()}" if k < 3 else f"Intro {k}\n\n{long.strip()}\n\nThe end" for k in range(6)}
    assert got == want


def test_wrappers_named_for_what_they_have():
    story = "<h1>Title</h1><p>" + "many words of the story " * 9 + "</p>"
    whole = html.Page(f"<article>{story}</article>").text([])
    opened = ["<div class='layout with-sidebar'>", "<div id=no-sidebar>", "<article class='post comments-open'>", "<main class=has-banner>", "<div class='page layout--with-sidebar'>", "<div class=search><main>", "<div class=header><div class=nav><article>"]
    for tags in opened:
        assert html.Page(f"<body>{tags}{story}").text([]) == whole, tags
    for name in ("sidebar", "nav-no-border", "site-header", "widget ad"):
        assert html.Page(f"<body><div class='{name}'><p>Menu</p></div><article>{story}</article>").text([]) == whole, name
    teaser = "<div class=related><article><p>Another story</p></article></div><div id=comments><p>" + "a long comment " * 50 + "</p></div>"
    assert html.Page(f"<body><div class=content>{story}</div>{teaser}").text([]) == whole


def test_long_attributes_end_at_their_quote():
    state = "x" * 5000 + " > y"
    assert html.Page(f"<p>a</p><div data-state='{state}' class=sidebar><p>side</p></div><p data-state=\"{state}\">b</p>").text([]) == "a\n\nb"


def test_long_and_broken_pages():
    assert html.Page("<p>" * 5000 + "x").text([]) == "x"
    assert html.Page("<div>" * 2000 + "y").text([]) == "y"
    assert html.Page('<p title="a > b">z</p><a href="unclosed>w').text([])[:1] == "z"
    assert html.Page("word " * 200_000).text([]) == " ".join(["word"] * 200_000)
    assert html.Page("<script>never closed <p>x</p>").text([]) == ""


def test_query(spark, small):
    r = queries.op1_html_extraction(spark, small)
    assert r.columns[:4] == ["page_id", "url", "text", "n_chars"]
    for x, page in zip(r.orderBy("page_id").collect(), spark.read.parquet(f"{small}/pages.parquet").orderBy("page_id").collect(), strict=True):
        assert x.page_id == page.page_id and x.text and "©" not in x.text
