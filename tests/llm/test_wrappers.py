"""Pages whose wrappers are named like furniture, and long stray markup."""

from __future__ import annotations

import time

import pytest

from pulsegrid.llm.html_text import Page

FIRST, SECOND = "A long sentence about rivers and hills. " * 8, "Second part with more words, and commas. " * 7
BODY = f"<p>{FIRST}</p><p>{SECOND}</p>"
WANT = f"{FIRST.strip()}\n{SECOND.strip()}"
REMARKS = '<div class="comments"><p>Nice one, thanks!</p></div>'


@pytest.mark.parametrize(
    "wrapper",
    ["<div>", '<div class="has-sidebar">', '<div id="page" class="no-sidebar site">', '<div class="layout-with-footer">', '<form id="aspnetForm">', '<div class="newsletter">'],
)
def test_wrappers_keep_the_article(wrapper):
    tag = wrapper[1:].split()[0].rstrip(">")
    source = f"<html><body><nav><a href=x>Home</a></nav>{wrapper}{BODY}</{tag}>{REMARKS}<footer>imprint</footer></body></html>"
    assert Page(source).main_text() == WANT


def test_article_in_a_wrapper_with_a_real_sidebar():
    source = f'<body><div class="sidebar-page"><article>{BODY}</article><div class="sidebar"><p>{"Other news. " * 30}</p></div></div></body>'
    assert Page(source).main_text() == WANT


def test_comments_marked_up_as_articles_go():
    remarks = '<section id="comments">' + '<article class="comment-body"><p>I do not agree with that at all.</p></article>' * 40 + "</section>"
    assert Page(f"<body><article>{BODY}</article>{remarks}</body>").main_text() == WANT
    assert Page(f"<body><div>{BODY}</div>{remarks}</body>").main_text() == WANT


def test_small_forms_and_notices_go():
    source = f'<body><form><p>Your name and address, please.</p></form><div class="cookie-notice"><p>We use cookies.</p></div><div>{BODY}</div></body>'
    assert Page(source).main_text() == WANT


@pytest.mark.parametrize("stray", ["</b>", "</b><hr>", "<p>", "</div>"])
def test_stray_tags_take_linear_time(stray):
    began = time.perf_counter()
    Page("<html><body><b><div>" + "<span>" * 50_000 + "x" + stray * 50_000).main_text()
    assert time.perf_counter() - began < 15
