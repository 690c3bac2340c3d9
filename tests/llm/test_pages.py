"""Main text of pages built from known blocks, and text that must not get lost."""

from __future__ import annotations

import html
import random

import pytest

from auditloom.llm import html_text

WORDS = "the of report water <system> & growth café 5% year «north» model a < b results 你好 we".split()


def sentence(rng, low, high):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) + "."


def paragraph(rng, text, links=True):
    """Markup of a block that shows ``text``: entities, inline tags, things that don't show, odd spaces."""
    out = []
    for word in text.split(" "):
        shown = html.escape(word) if rng.random() < 0.8 else "".join(f"&#{ord(c)};" for c in word)
        kind = rng.random()
        if kind < 0.08:
            shown = f"<b>{shown}</b>"
        elif kind < 0.12 and links:
            shown = f"<a href='/x?a=1&b=2'>{shown}</a>"
        elif kind < 0.15:
            shown += rng.choice(["<svg><text>no</text></svg>", "<script>if (a<b) x('</p>')</script>", "<select><option>no</option></select>",
                                 "<!-- no -->", "<button>no</button>", "<style>p{}</style>", "<span class=ad>no</span>"])
        elif kind < 0.18:
            shown = f"<math><mi>{shown}</mi></math>"
        out.append(shown)
    return rng.choice([" ", "\n  ", "&nbsp;", "<br>"]).join(out)


CLASSES = ["", ' class="comment-free"', " class='lead social-science'", " id=related-work", ' class="share-of-voice"', ' id="notice-period-law"', " class=has-sidebar"]
NOISE = [
    "<div class=ad>Buy this very good thing now, it is a good thing to buy.</div>", "<aside>Aside, with words in it.</aside>", "<form><input>Mail us</form>",
    '<div class="ad-container">Buy.</div>', '<div id="cookie-notice">We use cookies, please accept them all.</div>', "<script>var t='</p>';</script>",
    "<style>p{}</style>", "<noscript>no</noscript>", '<div class="related-posts"><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div>', "<iframe>no</iframe>",
]


def page(rng):
    """(markup, main text)"""
    blocks, shown = [], []
    for i in range(rng.randint(2, 14)):
        text = sentence(rng, 1, 5) if i == 0 or rng.random() < 0.25 else sentence(rng, 12, 60)
        tag = rng.choice(["h1"] if i == 0 else ["p", "p", "p", "h2", "blockquote", "div", "li"])
        blocks.append(f"<{tag}{rng.choice(CLASSES)}>{paragraph(rng, text, tag != 'li')}</{tag}>")
        shown.append(text)
        blocks += rng.choices(NOISE, k=rng.choice([0, 0, 0, 1, 2, 4]))
    main = rng.choice(["article", "main"])
    comments = "<section class='comments'><p>A reader says that this is wrong, and says so at some length, as they do.</p></section>"
    return (
        f"<!DOCTYPE html><html><head><title>T</title><script>'<article>'</script></head><body class='no-sidebar'><header><h1>Site</h1></header>"
        f"<nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav><{main}>{''.join(blocks)}{comments}</{main}>"
        f"<div class='sidebar'><p>Most read: one, two and three.</p></div><footer><p>&copy; the site, all rights reserved, as it were.</p></footer></body>"
    ), "\n".join(shown)


@pytest.mark.parametrize("seed", range(60))
def test_all_blocks_of_the_article_are_there(seed):
    markup, text = page(random.Random(seed))
    assert html_text.main_text(markup) == text


LONG = "A paragraph that is long enough to be the text of its page, by itself. " * 3


def test_short_end_after_adverts():
    ad = "<div class=ad>Buy.</div>"
    assert html_text.main_text(f"<article><p>{LONG}</p>{ad * 3}<p>Short end.</p></article>") == f"{LONG.strip()}\nShort end."


def test_title_before_an_advert_a_script_and_a_style():
    noise = "<div class=ad>Buy.</div><script>x()</script><style>p{}</style>"
    assert html_text.main_text(f"<article><h1>Title</h1>{noise}<p>{LONG}</p></article>") == f"Title\n{LONG.strip()}"


def test_elements_within_a_line_keep_its_rest():
    inline = "see a &lt; b <svg><path/></svg>and <math><mi>x</mi><mo>=</mo><mn>2</mn></math> or <select><option>1</option></select>tail"
    assert html_text.main_text(f"<article><p>{LONG}</p><p>{inline}</p></article>") == f"{LONG.strip()}\nsee a < b and x=2 or tail"


def test_names_of_classes():
    for name in ("ad", "ads", "top-ad", "ad-container", "comments", "comment-list", "cookie-notice", "main-nav", "nav-bar", "share-buttons", "sidebar-left",
                 "related-posts", "newsletter-signup", "page-footer", "site-header"):
        assert html_text.is_chrome("div", f' class="x {name}"', False), name
    for name in ("comment-free", "social-science", "related-work", "ad-hoc", "has-sidebar", "no-comments", "notice-period", "menu-engineering", "article-body", "share-of-voice", ""):
        assert not html_text.is_chrome("div", f' class="{name}"', True), name
