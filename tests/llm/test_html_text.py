from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpgrid.llm import html_text as H

LONG = "This is a sentence of an article, which goes on for a good while and has some clauses, so that it is long."
LIST = "<ul>" + "".join(f"<li><a href='/{i}'>Menu item {i}</a></li>" for i in range(8)) + "</ul>"


def page(body, head="<title>Title</title><style>p{color:red}</style><script>if (a<b) { x = '<p>no</p>'; }</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (f"<nav>{LIST}</nav><div class='ad'>Buy</div><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>", f"Head\n{LONG}\nShort."),
    "no article": (f"<div id='top-menu'>{LIST}</div><div class='content'><h1>Head</h1><p>{LONG}</p><p>{LONG} Two.</p></div><div class='comments'><p>{LONG} Reader.</p></div><div>Copyright 2024</div>", f"Head\n{LONG}\n{LONG} Two."),
    "no names": (f"<div>{LIST}</div><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><table><tr><td>{LIST}</td></tr></table>", f"Head\n{LONG}\n{LONG}"),
    "inside": (f"<article><header><h1>Head</h1><p>By someone</p></header><p>{LONG}</p><aside>Aside {LONG}</aside><form><p>Name</p></form><div class='newsletter-box'>Sign up</div><p>End.</p><section id='comments'><article class='comment'>Nice {LONG}</article></section></article>", f"Head\n{LONG}\nEnd."),
    "wrapper": (f"<div class='page with-sidebar'><main><p>{LONG}</p></main><div class='sidebar'>{LONG}</div></div>", LONG),
    "references": ("<article><p>a &amp; b &eacute;&#233;&nbsp;c&lt;d\n\n e</p></article>", "a & b éé c<d e"),
    "unclosed": (f"<article><p><b>One {LONG}<br><p>Two<p>Three</article><footer>no</footer>", f"One {LONG}\nTwo\nThree"),
    "breaks": (f"<article><p>One<br>line<br><br>Two</p></article>", "One line\nTwo"),
    "comment markup": (f"<article><!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><div class='cookie-notice'>no</div><p>yes</p></article>", "yes"),
    "textarea": (f"<article><textarea><p>no</p></textarea><p title='a>b'>yes</p></article>", "yes"),
    "board": (f"<article><p>{LONG}</p><div class='notice-board'>Board text</div><div class='social history'>History text</div></article>", f"{LONG}\nBoard text\nHistory text"),
    "cards": (f"<div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='related'><article><p>Other {LONG}</p></article></div><article><p>Teaser</p></article>", "\n".join(["Head", *[LONG] * 4])),
    "short page": ("<div><p>One line.</p><p>Two.</p></div>", "One line.\nTwo."),
    "copyright law": (f"<div><p>{LONG}</p><p>Copyright law changed, and this paragraph tells at some length how it did and what came of it in the end.</p><p>{LONG}</p></div>", f"{LONG}\nCopyright law changed, and this paragraph tells at some length how it did and what came of it in the end.\n{LONG}"),
    "linked": (f"<div><p>{LONG}</p><p><a href='/'>Half of this</a> is a link</p><p>{LONG}</p></div>", f"{LONG}\nHalf of this is a link\n{LONG}"),
    "whole in furniture": (f"<div class='sidebar-left'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    "whole in a form": (f"<form action='/'><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n{LONG}"),
    "long discussion": (f"<div><p>{LONG}</p></div><div class='user-comments'>" + f"<p>{LONG}</p>" * 30 + "</div>", LONG),
    "late short line": (f"<article><p>{LONG}</p>" + "<div class='ad'>Buy</div>" * 6 + "<p>End.</p></article>", f"{LONG}\nEnd."),
    "outside": (f"<div><p>{LONG}</p></div><article><h1>Head</h1><p>Of.</p></article><div><p>Promo {LONG}</p></div>", "Head\nOf."),
    "inline furniture": (f"<article><p>{LONG}<script>var a = 1;</script> and <button>Click</button>on.</p></article>", f"{LONG} and on."),
    "notices": (f"<div class='cookie-banner'><p>{LONG}</p></div><main><p>{LONG} Body.</p></main>", f"{LONG} Body."),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    body, want = CASES[name]
    assert H.main_text(page(body)) == want


def test_empty_pages():
    for html in (None, "", "<html></html>", page(""), page(f"<nav>{LIST}</nav>"), "<script>never closed", "<p"):
        assert H.main_text(html) == ""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<br>", "<script>", "</script>", "<!--", "-->", "<", ">", "&amp;", "text ", "<a href=\"x", "'", "<ul><li>", "</ul>", "<table><td>", "<h1>", "</body>"]), max_size=30))
def test_any_markup(parts):
    text = H.main_text("".join(parts))
    assert "\n\n" not in text and text == text.strip()


ODD = {
    "open tags": "<a " * 20_000,
    "open data": "<![CDATA[" * 20_000,
    "open comments": "<!--" * 20_000,
    "nested": "<div>t" * 20_000,
    "nested furniture": "<div class='ad'><h1>t" * 10_000,
    "end tags": "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000,
    "blocks in inline": "<div>" + "<i>" * 20_000 + "<div></div>" * 20_000,
    "quotes": '<a ">" ' * 20_000,
    "open quotes": "<a '" * 20_000 + "x>" * 20_000,
    "items": "<ul><li>a" * 20_000,
}


@pytest.mark.parametrize("name", ODD)
def test_broken_markup_takes_linear_time(name):
    began = time.process_time()
    H.main_text(ODD[name])
    assert time.process_time() - began < 3


def slow_surges(weights, window, threshold):
    """By the definition: every sum on its own."""
    found, inside = [], False
    for i in range(len(weights)):
        s = sum(weights[i : i + window])
        if not inside and s >= threshold and weights[i] > 0:
            found.append([i, len(weights)])
            inside = True
        elif inside and s <= 0:
            found[-1][1] = i
            inside = False
    return [tuple(x) for x in found]


@given(st.lists(st.sampled_from([0, 0, 0, 1, 20, 95, 400]), max_size=40), st.integers(1, 5), st.sampled_from([1, 50, 90]))
def test_surges_by_definition(weights, window, threshold):
    assert H.surges(np.array(weights, float), window, threshold) == slow_surges(weights, window, threshold)


def made_page(rng, scoped):
    """A page of random make, and its article's lines."""
    text = lambda n: " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=n))
    furniture = [
        lambda: f"<nav>{LIST}</nav>",
        lambda: f"<div id='main-menu'>{LIST}</div>",
        lambda: f"<div>{LIST}</div>",
        lambda: f"<div class='ad-slot'>{text(rng.randint(1, 60))}</div>",
        lambda: f"<aside><p>{text(60)}</p></aside>",
        lambda: f"<div class='cookie-law-info'><p>{text(40)}</p></div>",
        lambda: f"<section class='reader-comments'><p>{text(50)}</p><p>{text(90)}</p></section>",
        lambda: f"<form><p>{text(5)}</p><input></form>",
        lambda: f"<script>if (a < b) {{ '{text(9)}' }}</script>",
        lambda: "<div role='navigation'><p>" + text(9) + "</p></div>",
    ]
    some = lambda k: "".join(rng.choice(furniture)() for _ in range(rng.randint(0, k)))
    lines = [text(rng.randint(1, 8)), *(text(rng.randint(1 if scoped else 20, 90)) for _ in range(rng.randint(3, 12)))]
    inside = "".join(f"<p>{x.replace(' ', rng.choice([' ', chr(10)]))}</p>" + (some(2) if scoped else "") for x in lines[1:])
    body = f"<h1>{lines[0]}</h1>{inside}"
    body = f"<{rng.choice(['article', 'main'])}>{body}</article></main>" if scoped else f"<div class='post-content'>{body}</div>"
    return page(f"<header>{text(6)}</header>{some(4)}{body}{some(4)}<footer>{text(20)}</footer>"), lines


@pytest.mark.parametrize("scoped", [True, False])
def test_made_pages(scoped):
    rng = random.Random(5)
    for _ in range(300):
        html, lines = made_page(rng, scoped)
        assert H.main_text(html) == "\n".join(lines), html


def test_the_sums_decide_without_names(spark):
    """On the given pages, with the class names taken away, surge and dive alone find the same text, and leave lines out on all."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(250).collect()
    dropped = 0
    for r in pages:
        bare = r.html.replace(' class="ad"', "")
        text = H.main_text(bare)
        assert text == H.main_text(r.html)
        dropped += len(text) < sum(len(" ".join("".join(x.parts).split())) for x in H._Page(bare).lines)
    assert dropped > 0.9 * len(pages) > 0  # a few adverts have no text


def test_long_page():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert H.main_text(page(f"<article>{body}</article>")).count("\n") == 19_999


def test_table(spark):
    rows = [(1, "u", page(CASES["article"][0]), "clash"), (1, "u", page(CASES["article"][0]), "clash"), (None, None, None, None), (2, "v", "", "")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = CASES["article"][1]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, "v", "", 0)]))
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = "".join(f"<p>Sentence {i} of the article runs on for a while, so that it has the length of a common line of prose.</p>" for i in range(6))


@pytest.mark.parametrize("name", "comment-thread discussion-thread related-stories related-posts most-read trending recirc taboola outbrain share-buttons subscribe-cta donate-banner gallery-nav".split())
def test_names_of_furniture_in_and_outside_of_the_article(name):
    other = f'<div class="{name}"><p>A stranger says things here that are long enough to look like a line of the article itself.</p></div>'
    for page in (f"<article><h1>Title of the page</h1>{BODY}{other}</article>", f"<article><h1>Title of the page</h1>{BODY}</article>{other}"):
        text = H.main_text(f"<html><body>{page}</body></html>")
        assert "stranger" not in text and text.count("Sentence") == 6


def test_the_sums_decide_within_scopes():
    links = "<li><a href=x>Ef gh</a></li>" * 4
    page = f"<html><body><article><h1>Title of the page</h1>{BODY}<ul>{links}<li>Cd</li>{links}</ul></article></body></html>"
    text = H.main_text(page)
    assert text.count("Sentence") == 6 and "Cd" not in text
    assert "Cd" in H.main_text(page, surge=1)


def test_a_page_is_not_its_scope(small):
    """Another threshold changes the text of given pages, whose articles are scopes: sums are asked for their lines too."""
    rows = pd.read_parquet(f"{small}/pages.parquet")["html"].dropna().tolist()
    assert any(H.main_text(h) != H.main_text(h, surge=2000) for h in rows)
