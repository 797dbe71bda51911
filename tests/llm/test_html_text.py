import html
import re
from pathlib import Path

import pytest
from cases import prose

from pairrank.llm.html_text import extract_text, main_text

PAGES = "/root/testdata/sf0.001/pages.parquet"
LONG = "word " * 40


@pytest.mark.parametrize("page, text", [
    (None, ""),
    ("", ""),
    ("<p>Hi <b>th</b>ere</p><p>you</p>", "Hi there you"),
    ("<nav>menu</nav><article><h1>T</h1><p>One&nbsp;&amp; only</p></article><footer>foot</footer>", "T One & only"),
    (f"<div class='ad'>buy</div><div>{LONG}</div><footer>foot", LONG.strip()),
    ("a < b &amp; c", "a < b & c"),
    ("<article><p>One</p><section id='comments'><article class='comment'>no</article></section><p>two</p></article>", "One two"),
    ("<nav>open<article><p>y</p></article>", "y"),
    ("<body class='has-sidebar'><main><p>z</p></main><aside>q</aside>", "z"),
    ("<!-- <p>no</p> --><p>yes", "yes"),
    ("<p title=\"a>b\">t</p>", "t"),
    ("<p title='never closed>t</p><p>s</p>", "t s"),
    ("<article><p>a\n\n  b\tc</p><form><input>sign up</form><p>d</p><script>if (a < b) '</p>'</script></article>", "a b c d"),
    ("<header>site</header><article><header><h1>Title</h1></header><p>x</p><footer>meta</footer></article>", "Title x"),
    (f"<div><a href=1>{LONG}</a></div><div><p>{LONG}</p></div>", LONG.strip()),
    ("<article><p>x<br>y<p>z</article>", "x y z"),
    ("<style>p{}</style><title>t</title>", ""),
    ("<div role='navigation'>menu</div><article><div class='cookie-notice'>no</div><div>yes</div></article>", "yes"),
])
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<body><form action=x><input><article><h1>T</h1><p>{LONG}</p></article></form>", "T " + LONG.strip()),
    (f"<body><form action=x><select><option>no</select><div><p>{LONG}</p></div></form>", LONG.strip()),
    (f"<div class='layout with-sidebar'><p>{LONG}</p></div>", LONG.strip()),
    (f"<div class='page hasSidebar'><p>{LONG}</p><div class='sidebar'>short</div></div>", LONG.strip()),
    (f"<article><section id='discussion'><h2 id='related-work'>A</h2><p>{LONG}</p><h2 id='social-impact'>B</h2><p>c</p></section></article>",
     f"A {LONG.strip()} B c"),
    (f"<article><p>x</p><div id='related'><ul><li><a href=1>{LONG}</a></ul></div><div id='comments'><p>{LONG}</p></div></article>", "x"),
    (f"<article><p>x</p></article><div class='ad'>{LONG}</div>", "x"),
])
def test_forms_and_names(page, text):
    assert main_text(page) == text


CARD = "<article class='card'><h3><a href=1>Teaser</a></h3><p>Some short words.</p></article>"
LINKS = "<ul>" + "<li><a href=1>Some other story of the day, linked</a>" * 8 + "</ul>"


@pytest.mark.parametrize("page, text", [
    (f"<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>" + CARD * 4, f"T {LONG}{LONG}".strip()),
    (f"<main><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>{CARD * 4}</main>", f"T {LONG}{LONG}".strip()),
    (f"<article><h1>T</h1><p>{LONG}</p></article><div>{CARD * 3}</div>", f"T {LONG}".strip()),
    (f"<main><div>{LINKS}</div><div><h1>T</h1><p>{LONG}</p></div></main>", f"T {LONG}".strip()),
    (f"<main><h1>T</h1><p>{LONG}</p>{LINKS}</main>", f"T {LONG}".strip()),
    (f"<main><article><p>{LONG}</p></article><div>{LINKS}</div></main>", LONG.strip()),
    (f"<main><article><p>{LONG}</p></article><div><p>{LONG}</p></div></main>", (LONG * 2).strip()),
    (f"<article><p>short</p></article><div><p>{'x ' * 9}</p></div>", "short"),
    (f"<article><p>{LONG}</p><div class='ad'>x</div><p><a href=1>Source</a></p></article>", LONG + "Source"),
])
def test_article_and_main_are_evidence(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<div><h1>Title</h1></div><div><p>{LONG * 2}</p></div>", "Title " + (LONG * 2).strip()),
    (f"<div><div><h1>Title</h1></div><div>By me</div><div><p>{LONG}</p></div></div>", "Title By me " + LONG.strip()),
    (f"<div><div><h1>Title</h1></div></div><div><div><p>{LONG}</p></div></div>", "Title " + LONG.strip()),
    (f"<div><p>{LONG}</p><div class='ad'>buy</div><p>The end.</p></div>", LONG + "The end."),
    (f"<div><p>{LONG}</p><div class='ad'>buy</div><p>Short.</p><div class='ad'>buy</div><p>{LONG}</p></div>", f"{LONG}Short. {LONG}".strip()),
    (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", "Title " + LONG.strip()),
    (f"<div>{LINKS}</div><div><p>{LONG}</p></div><div>{LINKS}</div><div>Far off</div>", LONG.strip()),
])
def test_short_areas_beside_the_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p>The market <span class='share'>share</span> grew, see the <a class='menu-item'>File</a> menu.</p></article>",
     "The market share grew, see the File menu."),
    ("<article><p>Press <button>Start</button> and wait for the <label>name</label>.</p></article>", "Press Start and wait for the name."),
    ("<article><p>It ended. <a class='ad'>Buy now</a></p><p><span class='share'>Share</span></p></article>", "It ended."),
    ("<article><p>a <span class='share'>b <script>no</script></span>c</p></article>", "a c"),
    (f"<div><p>{LONG * 3}</p></div><div class='discussion'><p>{LONG}</p><p>{LONG}</p></div>", (LONG * 3).strip()),
    (f"<article><p>{LONG * 2}</p><div class='responses'><p>{LONG}</p></div></article>", (LONG * 2).strip()),
    (f"<div><p>{LONG * 3}</p></div><div class='notice'><p>{LONG}</p></div>", (LONG * 3).strip()),
    (f"<table><tr><td><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></td><td><p>{LONG}</p></td></tr></table>", LONG.strip()),
    (f"<div><p>{LONG}</p><p>© 2024 The Paper</p></div>", LONG.strip()),
    (f"<div><p>{LONG}</p></div><div><p>Copyright 2024 The Paper. All rights reserved.</p></div>", LONG.strip()),
    (f"<article><p>{LONG}</p><p>© 1990 is what the sign said</p></article>", LONG + "© 1990 is what the sign said"),
    (f"<div><p>Copyright 1710 was new.</p><p>{LONG}</p></div>", "Copyright 1710 was new. " + LONG.strip()),
    (f"<article><p>{LONG}</p><p hidden>no</p><div style='display: none'><p>no</p></div><p class='hidden x'>y</p></article>", LONG + "y"),
    (f"<article><p>{LONG * 9}</p></article><article><p>{LONG}</p></article>", (LONG * 10).strip()),
])
def test_running_text_and_unnamed_boilerplate(page, text):
    assert main_text(page) == text


def test_long_and_odd_pages_end():
    assert len(main_text("<p>" + prose(1, 200_000) + "</p>")) > 500_000
    for odd in ("<" * 200_000, "<a " * 100_000, "<div class='ad'>" * 20_000, "<p '" * 50_000, "&" * 100_000,
                "<b class='ad'>" * 20_000, "<b class='ad'>x</b> " * 50_000, "<b class='ad'>" * 9_000 + "<p>x" + "</b>" * 9_000):
        main_text(odd)


def test_table(spark):
    rows = [(1, "u", None, "x"), (None, None, "<article>a</article>", "x"), (2, "u", "<article>é\U0001f600</article>", None), (2, "u", "", "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "a", 1), (1, "", 0), (2, "", 0), (2, "é\U0001f600", 2)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not Path(PAGES).exists(), reason="no test tables")
def test_against_the_article_element(spark):
    for page in spark.read.parquet(PAGES).collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>|<br>", article))
        assert main_text(page.html) == " ".join(b for b in blocks if b)
