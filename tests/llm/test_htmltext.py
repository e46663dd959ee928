from __future__ import annotations

import pytest

from provlens.llm import htmltext


@pytest.fixture(scope="module")
def tree(spark):
    return htmltext.train(spark)


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href='/x>y'>More</a></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice"><p>We use cookies to improve many things on this site today.</p></div>
<article class="post"><h1>Title &amp; more</h1><p>First&nbsp;<b>bold</b>text,
 on two lines.<p>Unclosed &lt;tag&gt; &eacute;&#x41;<br>next<div class="ad">Buy this now and save a lot of money today</div>
<p>x</article><aside><p>Read also this and that, it is very good.</p></aside>
<section id="comments"><p>Great article, thank you for writing this long and fine text.</p></section>
<form><label>Your name and your mail address</label><input></form><footer>&copy; all rights</footer></body></html>"""


def test_article_without_surroundings(tree):
    assert htmltext.main_text(PAGE, tree) == (
        "Title & more\nFirst boldtext, on two lines.\nUnclosed <tag> éA next\nx")


def test_pages_without_semantic_tags(tree):
    words = "one two three four five six seven eight nine ten " * 4
    page = (f'<div><a href="#">Home</a> <a href="#">News</a></div><div class="menu"><p>{words}</p></div>'
            f'<div><p>{words}</p><p>{words} end</p></div><div>Share this</div>')
    assert htmltext.main_text(page, tree).split("\n") == [words.strip(), f"{words}end"]


@pytest.mark.parametrize("page", ["", None, "   ", "<", "<p", "<!--", "<script>x", "<nav><p>only a menu</nav>", "a < b > c"])
def test_odd_pages(tree, page):
    assert isinstance(htmltext.main_text(page, tree), str)


@pytest.mark.parametrize("before, after", [
    ("<html><head><title>x</title><body>", ""), ("<head><meta name=a><title>x</title>", "</html>"),
    ("<head><style>p{}</style><title>x</title><script>1</script></head>", ""),
    ('<svg width="1"/>', "<svg><text>no</text></svg>"), ("<math/><svg />", ""), ("<svg><path d='M0'>", ""),
    ("<button>Menu", "<button>no</button>"), ("<button>Menu", ""), ("<select><option>no<option>no", ""),
    ("<select><option>no", "<select><option>no</select>"), ("<iframe src=x>", ""), ("<noscript>", ""),
    ("<object><object>no</object>no</object>", ""), ("<button><script>'</button>'</script>no</button>", ""),
    ("", "<script>no"), ("", "<style>no"), ("", "<textarea>no <p>no</p>")])
def test_skipped_elements_without_end_tag(tree, before, after):
    words = "one two three four five six seven eight nine ten " * 4
    page = f"{before}<article><h1>Head</h1><p>{words}</p><p>{words} end</p></article>{after}"
    assert htmltext.main_text(page, tree).split("\n") == ["Head", words.strip(), f"{words}end"]


@pytest.mark.parametrize("wrap", [
    '<body class="has-sidebar">{}</body>', '<html class="no-comments"><body id="widget">{}',
    '<div id="page" class="with-sidebar">{}</div>', '<body><form id="aspnetForm" method="post">{}</form></body>',
    '<div class="page-header-on"><div class="has-comments">{}</div></div>', '<header>{}</header>'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "{}"])
def test_page_wide_side_hints(tree, wrap, inner):
    words = "one two three four five six seven eight nine ten " * 4
    body = inner.format(f"<p>{words}</p><p>{words} end</p>")
    side = ('<nav><a href="#">Home</a></nav>', '<div class="sidebar"><p>Read also this and that</p></div>'
            '<div id="comments"><article><p>Great, thank you for this long text.</p></article></div>' * (inner != "{}"))
    page = wrap.format(side[0] + body + side[1])
    assert htmltext.main_text(page, tree).split("\n") == [words.strip(), f"{words}end"]


def test_articles_in_layout_boxes_and_in_comments(tree):
    words = "one two three four five six seven eight nine ten " * 4
    page = (f'<div class="widget"><article><p>{words} a</p></article></div>'
            f'<div class="widget"><article><p>{words} b</p></article><p>Follow us here</p></div>'
            f'<div class="related"><article><p>{words} c</p></article></div><aside><article><p>{words} d</p></article></aside>')
    assert [x[-1] for x in htmltext.main_text(page, tree).split("\n")[:2]] == ["a", "b"]
    assert f"{words}c" not in htmltext.main_text(page, tree) and f"{words}d" not in htmltext.main_text(page, tree)


def test_comments_are_not_page_wide_beside_plain_paragraphs(tree):
    words = "one two three four five six seven eight nine ten " * 4
    page = f'<p>{words}</p><p>{words} end</p><div class="comments"><p>{words} no</p></div>'
    assert f"{words}no" not in htmltext.main_text(page, tree)
    assert htmltext.main_text(f'<main class="with-sidebar"><p>{words}</p></main>', tree) == words.strip()


def test_deep_pages_take_linear_time(tree):
    page = '<div class="content"><article class="x">' * 30_000 + "<p>word and word</p>"
    assert htmltext.main_text(page, tree) == "word and word"


def test_many_unclosed_elements_take_linear_time(tree):
    page = "<article>" + "<p>word and word<button>x<svg>" * 50_000 + "</article>"
    assert len(htmltext.main_text(page, tree).split("\n")) == 50_000


def test_labelled_table_is_learnt(tree):
    rows = htmltext.labelled_blocks()
    assert 0 < sum(r[-1] for r in rows) < len(rows)
    assert sum(htmltext.classify(tree, r[:-1]) == (r[-1] > 0.5) for r in rows) / len(rows) > 0.97


def test_query_columns_nulls_and_extra_columns(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "old", 3), (1, "u", PAGE, "old", 3), (None, None, None, None, None), (3, "v", "", "t", 0)],
        "page_id bigint, url string, html string, text string, n_chars bigint")
    rows = htmltext.extracted(pages).collect()
    assert [r["n_chars"] for r in rows if r["page_id"] == 1] == [len(rows[0]["text"])] * 2
    assert [(r["url"], r["text"], r["n_chars"]) for r in rows if r["page_id"] != 1] == [(None, "", 0), ("v", "", 0)]
    assert htmltext.extracted(pages.limit(0)).collect() == []


def test_very_long_page(tree):
    page = "<article>" + "<p>word and word</p>" * 50_000 + "</article>"
    assert len(htmltext.main_text(page, tree).split("\n")) == 50_000


LONG = "one two three four five six seven eight nine ten " * 4


@pytest.mark.parametrize("heading", [
    '<header class="entry-header"><h1>{}</h1></header>', '<header><h1>{}</h1></header>', '<div class="post-header"><h2>{}</h2></div>',
    '<header class="article-header wide"><h1>{}</h1></header>', '<h1 class="header">{}</h1>'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", '<body class="x"><article class="post">{}</article>'])
def test_headings_inside_the_article_stay(tree, heading, inner):
    page = inner.format(heading.format("Title here") + f"<p>{LONG}</p><p>Short.</p><p>{LONG}end</p>")
    assert htmltext.main_text(page, tree).split("\n") == ["Title here", LONG.strip(), "Short.", f"{LONG}end"]


@pytest.mark.parametrize("name", ["related-work", "search-methods", "related", "form-and-content"])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_sections_named_like_surroundings_stay(tree, name, tag):
    page = (f'<nav><a href="#">Home</a></nav><article><p>{LONG}</p><{tag} id="{name}"><h2>Section</h2><p>{LONG}</p><p>No.</p></{tag}>'
            f'<p>{LONG}end</p><div class="related"><a href="#">Read this one</a> <a href="#">and that one</a></div></article>')
    assert htmltext.main_text(page, tree).split("\n") == [LONG.strip(), "Section", LONG.strip(), "No.", f"{LONG}end"]


@pytest.mark.parametrize("short", [["Yes."], ["He said no."], ["Yes.", "He said no.", "Why?"]])
@pytest.mark.parametrize("wrap", ["<div>{}</div>", '<div id="a1">{}</div>', "<body><div><div>{}</div></div></body>", "<section>{}</section>"])
def test_short_paragraphs_between_long_ones_stay(tree, short, wrap):
    body = f"<p>{LONG}</p>" + "".join(f"<p>{s}</p><p>{LONG}</p>" for s in short)
    page = f'<div><a href="#">Home</a> <a href="#">News</a></div>{wrap.format(body)}<div>Share this</div><div><a href="#">Next</a></div>'
    assert htmltext.main_text(page, tree).split("\n") == [LONG.strip()] + [x for s in short for x in (s, LONG.strip())]


@pytest.mark.parametrize("box", [
    '<section class="responses">{}</section>', '<div id="discussion">{}</div>', '<div class="comment-list">{}</div>',
    '<section id="respond">{}</section>', '<div class="reader-feedback">{}</div>', '<ol class="comments">{}</ol>'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>"])
def test_reader_comments_go(tree, box, inner):
    said = box.format(f"<p>Great piece, {LONG}</p><p>I agree.</p>")
    page = inner.format(f"<h1>Head</h1><p>{LONG}</p><p>{LONG}end</p>") + said
    assert htmltext.main_text(page, tree).split("\n") == ["Head", LONG.strip(), f"{LONG}end"]
