"""Pages that name their parts misleadingly, leave things open, or are made of links; and time on pages of a megabyte."""

from __future__ import annotations

import time

import pytest

from kinetrace.llm.html import main_text

BODY = "The quick brown fox jumps over the lazy dog and then it runs along the river bank. " * 3


def article(inner: str) -> str:
    return f'<html><body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>{BODY}</p>{inner}<p>{BODY}</p></article><footer>Imprint</footer></body></html>'


@pytest.mark.parametrize("name", "share-price related-work social-history notice-period menu-planning comment-section-law ad-spend sidebar-note banner-headline promo-code-study navigation-methods".split())
def test_sections_about_such_things_are_text(name):
    for attribute in ("class", "id"):
        text = main_text(article(f'<section {attribute}="{name}"><h2>Part</h2><p>Real body text</p></section>'))
        assert "Part Real body text" in text and "Home" not in text and "Imprint" not in text


@pytest.mark.parametrize("inner", ["<form>Subscribe now</form>", "<form action=x>Subscribe now</form>", '<div class="newsletter">Subscribe now</div>', '<div class="share-buttons"><a href=a>Subscribe now</a></div>', '<div class="promo-code-study"><input name=q> Subscribe now</div>', '<aside>Subscribe now</aside>'])
def test_forms_and_notices_are_not(inner):
    assert main_text(article(inner)) == " ".join(["Title", BODY.strip(), BODY.strip()])
    assert "Subscribe" not in main_text(f"<html><body><div><p>{BODY}</p><p>{BODY}</p></div>{inner}</body></html>")


def test_anchors_of_headings_say_nothing():
    assert "On theory" in main_text(article('<h2 id="comments-on-theory">On theory</h2><p>Words.</p>'))
    assert "Notice" in main_text(article('<h2 id="notice">Notice</h2><p>Words.</p>'))


def test_an_article_of_links_is_text():
    links = " ".join(f'<a href="{i}">Entry {i}</a>' for i in range(30))
    want = " ".join(f"Entry {i}" for i in range(30))
    assert main_text(f"<html><body><nav><a href=a>Home</a></nav><article><p>{links}</p></article></body></html>") == want
    assert main_text(f"<html><body><nav><a href=a>Home</a></nav><article><h1>Index</h1><p>{links}</p></article></body></html>") == f"Index {want}"
    assert main_text("<html><body><nav><a href=a>Home</a></nav><article></article></body></html>") == ""


@pytest.mark.parametrize("name", ["discussion", "comments", "user-comments-section-wrap", "comments-area"])
@pytest.mark.parametrize("around", ["article", "div"])
def test_reader_comments_go(name, around):
    page = f'<html><body><{around}><p>{BODY}</p><p>{BODY}</p></{around}><div class="{name}"><p>I disagree with this piece, it is wrong on so many levels that I cannot count them.</p></div></body></html>'
    assert main_text(page) == " ".join([BODY.strip()] * 2)


def test_a_discussion_inside_the_article_is_part_of_it():
    assert "We found much" in main_text(article('<section class="discussion"><h2>Discussion</h2><p>We found much.</p></section>'))


def test_unfinished_markup_is_no_text():
    assert main_text(f"<p>{BODY}</p><!-- oops") == main_text(f"<p>{BODY}</p><a <a <a") == main_text(f"<p>{BODY}</p></di") == BODY.strip()
    assert main_text("<p>a < b and c</p> 1 < 2") == "a < b and c 1 < 2"
    assert main_text(f"<p>{BODY}</p><!--><p>One.</p><!---><p>Two.</p><!-- x --!><p>Three.</p>").endswith("One. Two. Three.")


HOSTILE = {
    "unmatched inline tags": "<p>x" + "<i>" * 100_000 + "</u>" * 100_000, "unfinished tags": "<p>x</p>" + "<a " * 330_000, "open comments": "<!--" * 250_000, "open headings": "<h1>" * 250_000,
    "ends beyond a block": "<u><div>" + "<i>" * 120_000 + "</u>" * 120_000, "signs": "<" * 1_000_000, "instructions": "<?" * 500_000, "ends": "</" * 500_000, "open quotes": '<a b="' * 160_000, "references": "<p>x" + "&amp" * 200_000,
    "depth": "<div>" * 100_000 + "x", "sections": "<![CDATA[" * 100_000, "declarations": "<!x " * 250_000, "script ends": "<script>" + "</scrip " * 120_000,
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_a_megabyte_of_open_things_takes_seconds(kind):
    began = time.process_time()
    main_text(HOSTILE[kind])
    assert time.process_time() - began < 10
