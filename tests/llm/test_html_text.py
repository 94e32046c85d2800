import html as escapes
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from threadloom.llm.html_text import extract, main_text
from threadloom.llm.queries import op3_html_text

LONG = "Words of an article, with commas, that go on for a while so that it counts as text. " * 3


def article(page):
    """The text blocks of a page's article element, as its tags delimit them."""
    own = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    own = re.sub(r"</?b>", "", own.replace("<br>", " "))
    blocks = [re.sub(r"\s+", " ", escapes.unescape(x)).strip() for x in re.split(r"<[^>]+>", own)]
    return "\n\n".join(b for b in blocks if b)


def test_query_equals_brute_force(spark):
    pages = {r["page_id"]: (r["url"], article(r["html"])) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in op3_html_text(spark, SF).collect()}
    assert found == {i: (u, t, len(t)) for i, (u, t) in pages.items()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<!-- only a comment", ""), ("<p>short</p>", "short"), ("plain &amp; text", "plain & text"),
        (f"<nav>Menu</nav><div id=main><h1>Title</h1><p>{LONG}<p>{LONG}</div><footer>{LONG}</footer>", f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<div class='post'><p>{LONG}</p><ul><li>one<li>two</ul></div><div class='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG.strip()}\n\none\n\ntwo"),
        (f"<div><a href=x>{LONG}</a></div><div><p>{LONG}</p></div>", LONG.strip()),
        (f"<article><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form><script>if (a<b) x('</p>')</script><p>tail &#x263A;&nbsp;end</p></article>", f"{LONG.strip()}\n\ntail ☺ end"),
        (f"<main><p>{LONG}</p><div hidden>secret</div><div role=navigation>go</div><pre>a\n  b</pre></main>", f"{LONG.strip()}\n\na b"),
        ("<style>p{}</style><P>Upper <B>case</B> tags<BR>break</P>", "Upper case tags break"),
        ("a < b and c > d", "a < b and c > d"), ("<" * 200, "<" * 200),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


L = LONG.strip()
S = "A short one."


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        # Containers of several kinds, none of which is a flat article element.
        (f"<article><div><p>{L}</p></div><div><p>{S}</p></div></article>", [L, S]),
        (f"<div><section><p>{L}</p></section><section><p>{L}</p></section></div>", [L, L]),
        (f"<body><div><div><p>{L}</p><p>{L}</p></div><p>{S}</p></div></body>", [L, L, S]),
        (f"<div><h1>Title</h1><div><p>{L}</p></div></div>", ["Title", L]),
        (f"<div><div class=row><div><p>{L}</p></div></div><div class=row><div><p>{L}</p><p>{L}</p></div></div></div>", [L, L, L]),
        (f"<table><tr><td><a href=1>{S}</a> <a href=2>{S}</a></td><td><p>{L}</p><p>{S}</p></td></tr></table>", [L, S]),
        (f"<main><h1>Title</h1><section><h2>Part</h2><p>{L}</p></section><section><h2>Next</h2><ul><li>{S}</li></ul></section></main>", ["Title", "Part", L, "Next", S]),
        (f"<div id=content>{L}<br>{S}<br><br>{L}</div><div id=footer>{L}</div>", [f"{L} {S} {L}"]),
        (f"<div class=story><blockquote>{L}</blockquote><pre>x = 1</pre><p>{L}</p></div>", [L, "x = 1", L]),
        (f"<article><header><h1>Head</h1><p>By me</p></header><p>{L}</p></article>", ["Head", L]),
        (f"<article><header class=header><div><h1>Head</h1></div><nav>Go</nav></header><p>{L}</p></article>", ["Head", L]),
        # What is no article, by its names.
        (f"<article><p>{L}</p><article class='comment'><p>{L}</p></article></article>", [L]),
        (f"<div><p>{L}</p><div id='commentSection'><p>{L}</p><p>{L}</p></div></div>", [L]),
        (f"<div><p>{L}</p><div class='discussion replies'><p>{L}</p></div></div>", [L]),
        (f"<div><p>{L}</p><ins class='adsbygoogle'>buy</ins><div class=gdpr>{L}</div><div class=disclaimer>{L}</div></div>", [L]),
        (f"<div><p>{L}</p><ul><li><a href=1>{S}</a><li><a href=2>{S}</a><li><a href=3>{S}</a></ul></div>", [L]),
        (f"<div><p>{L}</p><div class='share-buttons'>Tell others</div></div>", [L]),
        (f"<div><div><p>{L}</p></div><p>Copyright 2020 {S}</p></div>", [L]),
        # What its names only seem to leave out.
        (f"<div><p>{L}</p><p class='social-history'>{L}</p><div class='entry-header'><h2>Head</h2></div></div>", [L, L, "Head"]),
        (f"<div class='page with-sidebar'><p>{L}</p></div>", [L]),
        (f"<div class='sidebar-layout'><p>{L}</p><p>{L}</p><p>{L}</p></div>", [L, L, L]),
        (f"<section id=discussion><p>{L}</p></section>", [L]),
        # Readers speak longer than the article.
        *[(f"<div><article><p>{L}</p><p>{S}</p></article><{tag}>{f'<p>{L}</p>' * 6}</{end}></div>", [L, S]) for tag, end in (("div class=thread", "div"), ("div class=talk", "div"), ("section", "section"), ("div class='user-feedback'", "div"))],
        (f"<main><p>{L}</p></main><section>{f'<p>{L}</p>' * 5}</section>", [L]),
        (f"<article><p>{L}</p><h2>3 Comments</h2><ol><li>{L}</li><li>{L}</li></ol></article>", [L]),
        (f"<div><p>{L}</p><p>{L}</p><div><h3>Leave a reply</h3><p>{L}</p></div></div>", [L, L]),
        (f"<article><p>{L}</p><h2>Comments</h2><p>{L}</p><h2>Sequel</h2><p>{L}</p></article>", [L, "Sequel", L]),
        (f"<article><p>{L}</p><div class=thread><p>{L}</p></div></article>", [L]),
        *[(f"<article><p>{L}</p><div {name}><p>{L}</p></div></article>", [L]) for name in ("class=adbox", "data-ad", "data-ad-slot=3", "class=banner", "id=cookiebar", "class='cookie-notice'", "class=relatedPosts", "class='login-form'")],
        # Parts of the article that only their names speak against, and its sources.
        *[(f"<article><p>{L}</p><div class='{name}'><p>{L}</p></div></article>", [L, L]) for name in ("related-work", "login-guide", "promotion-history", "menu-of-the-day")],
        (f"<article><p>{L}</p><h2>Sources</h2><ul><li><a href=1>{S}</a><li><a href=2>{S}</a><li><a href=3>{S}</a></ul></article>", [L, "Sources", S, S, S]),
        (f"<article><p>{L}</p><h2>Related stories</h2><ul><li><a href=1>{S}</a><li><a href=2>{S}</a><li><a href=3>{S}</a></ul></article>", [L, "Related stories"]),
        (f"<article><div class=banner><h1>Head</h1></div><p data-address=x>{L}</p></article>", ["Head", L]),
        # Elements within a line that are left out, nested or never closed.
        (f"<article><p>{L} <span class=promo>buy <span>now</span> cheap</span> end</p></article>", [f"{L} end"]),
        (f"<article><p>{L} <span class=promo>buy <p>{S}</article>", [L, S]),
        (f"<article><p>{L} <button>Play <b>now</b></button> end</p></article>", [f"{L} end"]),
        (f'<article><p>{L}</p><p title="a > b">{S}</p><p class="x>{S}</p></article>', [L, S, S]),
    ],
)
def test_layouts(page, blocks):
    assert extract(page) == "\n\n".join(blocks)


def test_time_is_linear():
    for page in ("<span class=promo>x " * 50_000, "<div>x" * 50_000, "<div>" * 30_000 + "</p>" * 30_000 + "<h1>x</h1>" * 3_000, '<a "' * 50_001, "<script>" * 50_000):
        began = time.process_time()
        extract(page)
        assert time.process_time() - began < 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href='x'>", "</a>", "<li>", "<b>", "<!--", "-->", "<script>", "</script>", "text, ", "&amp;", "<", ">", '"', "<td>", "<br/>"]), max_size=40).map("".join))
def test_any_markup_is_accepted(page):
    assert isinstance(extract(page), str)


def test_edge_cases(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", f"<p>{LONG * 2000}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    found = [(r["page_id"], r["url"], r["text"]) for r in main_text(pages).collect()]
    assert sorted(found, key=lambda r: (str(r[0]), len(r[2]))) == [(1, "u", ""), (1, "u", (LONG * 2000).strip()), (None, None, "")]
    assert main_text(pages.limit(0)).count() == 0
