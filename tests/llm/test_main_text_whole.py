from __future__ import annotations

import random

import pytest

from ledgerlens.llm import line_blocks

LONG = " ".join(["A long paragraph of ordinary prose that goes on."] * 12)


def test_short_stretches_and_text_outside_an_article_are_kept():
    close = "A closing paragraph that is much shorter than the others but belongs to the text all the same."
    page = f"<body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div class=ad>Buy this</div><p>{close}</p></body>"
    assert line_blocks.main_text(page) == "\n".join([LONG] * 3 + [close])
    assert line_blocks.main_text(f"<p>{LONG}</p><article><p>A teaser.</p></article>") == f"{LONG}\nA teaser."


def test_class_words_in_longer_names_are_no_furniture():
    for marks in ("content has-sidebar", "with-sidebar", "no-sidebar", "elementor-widget-container"):
        assert line_blocks.main_text(f'<body><div class="{marks}"><p>{LONG}</p></div><div class="sidebar">Side</div></body>') == LONG
    for head in ('<header class="entry-header"><h1>Headline</h1></header>', '<div class="post-header"><h1>Headline</h1></div>'):
        assert line_blocks.main_text(f"<article>{head}<p>{LONG}</p></article>") == f"Headline\n{LONG}"


def test_an_element_with_most_of_the_text_is_read_whatever_its_class():
    page = f'<div class="layout sidebar-left"><p>{LONG}</p><div class="ad">Buy this</div></div><div class="menu">One two</div>'
    assert line_blocks.main_text(page) == LONG
    assert line_blocks.main_text(f"<p>Short text.</p><div class=comments><p>{LONG}</p></div>") == "Short text."


MENU = "<div><ul><li>Home</li><li>About us</li><li>Contact</li></ul></div>"
LINKS = "<div><ul>" + "".join(f'<li><a href="/{n}">A linked headline of some length, number {n}</a></li>' for n in range(6)) + "</ul></div>"
FOOTER = "<div>Copyright 2024 Example Company, all of it, in every country and in every language there is</div>"
TEXT = f"<h1>Headline</h1><div>By A. Writer</div><p>{LONG}</p><ul><li>One</li><li>Two</li></ul><p>{LONG}</p><p>The end.</p>"
KEPT = f"Headline\nBy A. Writer\n{LONG}\nOne\nTwo\n{LONG}\nThe end."


@pytest.mark.parametrize("before", ["", MENU, LINKS, MENU + LINKS])
@pytest.mark.parametrize("after", ["", FOOTER, LINKS, "<h3>Related</h3>" + LINKS + FOOTER, MENU + FOOTER])
def test_unmarked_menus_links_and_footers_go_by_the_windows(before, after):
    assert line_blocks.main_text(f"<body>{before}<div>{TEXT}</div>{after}</body>") == KEPT


def test_marked_content_is_never_cut():
    assert line_blocks.main_text(f"<article><ul><li>Tea</li></ul><p>{LONG}</p><ul><li>End</li></ul></article>") == f"Tea\n{LONG}\nEnd"
    assert line_blocks.main_text(f"<p>Intro.</p><p>{LONG}</p><ol><li>Step</li></ol><table><tr><td>7</td></tr></table>") == f"Intro.\n{LONG}\nStep\n7"
    assert line_blocks.main_text("<ul><li><a href=x>Only</a></li><li><a href=y>links</a></li></ul>") == "Only\nlinks"


@pytest.mark.parametrize("marks", ["share-price", "social-science", "alert-article", "related-work", "notice-of-meeting", "banner-history"])
def test_what_a_class_hides_is_read_where_it_holds_most_of_the_text(marks):
    assert line_blocks.main_text(f'{MENU}<div class="{marks}"><p>{LONG}</p></div><p>The end.</p>') == f"{LONG}\nThe end."


def test_windows_against_plain_sums():
    rng = random.Random(4)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 3, 8, 40, 300]) for _ in range(rng.randint(0, 25))]
        bar = line_blocks.WINDOW * line_blocks.bar_of(lengths)
        full = [at for at in range(len(lengths)) if sum(lengths[at : at + line_blocks.WINDOW]) >= bar]
        if full:
            assert line_blocks.between_surge_and_dive(lengths, bar) == (full[0], min(full[-1] + line_blocks.WINDOW, len(lengths)))
        half = [n for n in lengths if 2 * sum(m for m in lengths if m >= n) >= sum(lengths)]
        assert line_blocks.bar_of(lengths) == max(half, default=0) ** 0.5
