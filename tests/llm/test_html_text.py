"""HTML extraction on the given pages and on pages of many layouts."""

import html
import re
import time

import pytest

from __spark_entry__ import queries
from rentscope.llm import html_text

A = "The committee met on Tuesday and talked for three hours about the new bridge over the river, its cost and its colour."
B = "Nobody could agree on the colour, but the cost was settled at last, and the mayor thanked all members for their patience."
C = "Work begins in spring &amp; should end within two years, if the weather holds and the money does not run out before that."
PLAIN = html.unescape(f"{A} {B} {C}")
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(12)) + "</ul></nav>"


@pytest.mark.parametrize("page", [
    f"<html><body>{NAV}<div id=content><p>{A}</p><p>{B}</p><p>{C}</p></div><footer>Copyright, all rights reserved by the owner</footer></body></html>",
    f"<body><header><h1>Site name</h1></header><main><p>{A}<p>{B}<p>{C}</main><aside><p>Buy this and that, at a good price, today</p></aside>",
    f"<div class=\"wrap has-sidebar\"><div class='post'><p>{A}</p><p>{B}</p></div><div class='post'><p>{C}</p></div></div>",
    f"<article><p>{A}</p><div class=\"ad\">{B}</div><p>{B}</p><p>{C}</p><section id=\"comments\"><p>{A} I do not think so.</p></section></article>",
    f"<article><p>{A}</p><form><p>Your name</p><input><button>Send</button></form><p>{B}</p><p>{C}</p></article><div class='comments-area'><p>{A}</p></div>",
    f"<div id=cookie-notice>{A} We use cookies. {B}</div><div><p>{A}</p><p>{B}</p><p>{C}</p></div>",
    f"<script>if (a < b) document.write('<p>{A}</p>')</script><style>p {{ color: red }}</style><p>{A}</p><!-- <p>no</p> --><p>{B}</p><p>{C}</p>",
    f"<table><tr><td>{NAV}<td><p>{A}</p><p>{B}</p><p>{C}</p></table>",
    f"<BODY><DIV><P>{A}<BR>{B}</P>\n\n<P>{C}</P></DIV></BODY>",
    f"<div style='display:none'>{A}</div><div><p>{A}<p>{B}<p>{C}</div><div role=alert>{A}</div>",
    f"<body>{A}<br>{B}<br>{C}</body>",
    f"<div><div><p>{A}</p></div><div><p>{B}</p></div><div><p>{C}</p></div></div>" + NAV,
])
def test_layouts(page):
    assert html_text.main_text(page) == PLAIN


def test_spaces_and_references():
    assert html_text.main_text("<p>a<b>b</b>c&nbsp;&lt;d&gt; &#233;&#x4e2d;\n\t e</p><ul><li>x<li>y</ul>") == "abc <d> é中 e x y"
    for page in (None, "", "   ", "<html></html>", "<nav>menu</nav>", "<p", "<!--", "<script>"):
        assert html_text.main_text(page) == ""
    assert html_text.main_text("1 < 2") == "1 < 2"
    deep = "<div>" * 3000 + "<p>" + A + "</p>"
    assert html_text.main_text(deep) == A
    assert html_text.main_text("</p></div>" + A + "</article>") == A
    assert len(html_text.main_text("<p>" + (A + " ") * 3000)) == (len(A) + 1) * 3000 - 1


def brute(page):
    """The given pages hold one article each."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r.page_id, r.url, t, len(t)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect() for t in [brute(r.html)]}
    assert {tuple(r) for r in queries()["op2_html_text"](spark, sf).collect()} == want


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "u", 5), (1, f"<p>{A}</p>", None, 5), (None, f"<p>{A}</p>", "u", None)], "page_id long, html string, url string, text int")
    rows = html_text.extract(pages, ["page_id", "url", "text"]).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, A, len(A)), (1, "", 0), (1, A, len(A))]
    assert html_text.extract(pages.limit(0), ["page_id"]).count() == 0


def test_teasers_in_articles_do_not_replace_the_text():
    teasers = "".join(f"<article><h3>Story {i}</h3><p>{A[:40]}</p></article>" for i in range(4))
    text = html_text.main_text(f"<body><div id=content><p>{A}</p><p>{B}</p><p>{C}</p></div><div>{teasers}</div></body>")
    assert PLAIN in text


@pytest.mark.parametrize("wrapper", ["form id=aspnetForm", "fieldset", "object", "div role=form", "form class=comment"])
def test_a_form_around_the_whole_page_keeps_its_text(wrapper):
    inner = f"{NAV}<div><p>{A}</p><p>{B}</p><p>{C}</p></div><form><label>Your name</label><input><button>Send</button></form>"
    assert html_text.main_text(f"<body><{wrapper}>{inner}</{wrapper.split()[0]}></body>") == PLAIN


STORY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
REMARKS = "".join(f"<li class='comment'><article class='comment-body'><p>{A} I do not think so at all. {B}</p></article></li>" for _ in range(4))


@pytest.mark.parametrize("page", [
    f"<body><article>{STORY}</article><div id=comments><ol>{REMARKS}</ol></div></body>",
    f"<body><div class=post>{STORY}</div><div id=comments><ol>{REMARKS}</ol></div></body>",
    f"<body><main><div>{STORY}</div><div id='comments'><ol>{REMARKS}</ol></div></main></body>",
    f"<body><article>{STORY}</article><article class='comment'><p>{B}</p></article></body>",
    f"<body><div>{STORY}</div><div class='related'><article><h3>Other</h3><p>{A}</p></article></div></body>",
    f"<body class='comments-open'><div class='promo-layout'>{NAV}<article class='post comments-open'>{STORY}</article></div></body>",
])
def test_comments_and_related_cards_stay_out(page):
    assert html_text.main_text(page) == PLAIN


@pytest.mark.parametrize("start", ["<p title=don't>", "<p don't>", "<p title='a > b'>", '<p title = "it\'s">', "<p title='a hidden gem' class=x>", "<p title=a\"b>", "<p a==b c='>'/>"])
def test_quotes_in_tags(start):
    assert html_text.main_text(f"<body><div>{start}{A}</p><p>{B}</p><p title='x'>{C}</p></div></body>") == PLAIN


def test_unbalanced_quotes_take_linear_time():
    took = []
    for n in (4_000, 64_000):
        page = "<p title=don't>it is so</p>" * n + "<a <a " * n
        began = time.process_time()
        html_text.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 60 * took[0] + 1
