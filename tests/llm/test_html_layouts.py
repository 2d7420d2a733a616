"""HTML extraction on pages laid out otherwise than the given ones."""

from __future__ import annotations

import re
import time
from collections import Counter

import pyarrow.dataset as ds
import pytest

from tests.llm.test_chat_warc_html import LONG, by_markup
from vaultlens.llm import html

BAR = '<a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a>'


def given_pages():
    return ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table().to_pylist()


def model_of(rows):
    found = Counter()
    for row in rows:
        page = html.Page(row["html"])
        labels = page.labels_by_markup()
        for tags in html.UNNAMED:
            found += html.counts_of(page.without(tags), labels)
    return html.Model(html.balanced(html.seed_counts(), found))


@pytest.fixture(scope="module")
def models():
    """Of the seed pages alone, and with every second given page."""
    return [html.Model(html.seed_counts()), model_of(given_pages()[::2])]


LAYOUTS = {
    "divs": (f"<html><body><div>{BAR}</div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div>Copyright 2024 Acme. All rights reserved.</div></body></html>", f"T {LONG} {LONG}"),
    "divs without paragraphs": (f"<html><body><div>{BAR}</div><div>{LONG}</div><div>{LONG}</div><div>&copy; 2024 Acme</div></body></html>", f"{LONG} {LONG}"),
    "one wrapper": (f'<body><div id="w"><div>{BAR}</div><div>{LONG}<br>{LONG}</div><div>(c) 2024 Acme</div></div></body>', f"{LONG} {LONG}"),
    "table rows": (f"<html><body><table><tr><td>{BAR}</td></tr><tr><td><p>{LONG}</p><p>{LONG}</p></td></tr></table></body></html>", f"{LONG} {LONG}"),
    "table cells": (f'<html><body><table><tr><td><a href="/">Home</a></td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table></body></html>', f"{LONG} {LONG}"),
    "comments inside": (f'<article><p>{LONG}</p><div class="comments"><p>Reader says so, and it is good.</p></div></article>', LONG),
    "comments after": (f'<body><article><p>{LONG}</p></article><section id="comments"><p>Reader says so, and it is good.</p></section></body>', LONG),
    "main": (f"<body><main><p>{LONG}</p></main></body>", LONG),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(models, name):
    page, text = LAYOUTS[name]
    assert [model.extract(page) for model in models] == [text] * len(models)


@pytest.mark.parametrize("name", ["share-prices", "side-effects", "legal-analysis", "reply-to-smith", "ad-hoc-network", "tags-in-html"])
def test_a_word_of_a_name_does_not_decide(models, name):
    inner = f'<section class="{name}"><h2>U</h2><p>{LONG}</p></section><p id="{name}">{LONG}</p>'
    page = f"<body><nav>{BAR}</nav><article><h1>T</h1><p>{LONG}</p>{inner}</article><footer>x</footer></body>"
    assert [model.extract(page) for model in models] == [f"T {LONG} U {LONG} {LONG}"] * len(models)


@pytest.mark.parametrize("name", ["cookie-banner", "acme-sidebar", "x-comments-y", "related-xyz", "site-header", "post-comments"])
def test_named_parts_beside_the_text(models, name):
    page = f'<body><div class="{name}">We use cookies</div><div class="post-content"><h2>T</h2><p>{LONG}</p></div><div class="{name}"><p>{LONG}</p></div></body>'
    assert [model.extract(page) for model in models] == [f"T {LONG}"] * len(models)


@pytest.mark.parametrize("tags", ["article", "article|main|nav|header|footer|aside|section"])
def test_held_out_pages_without_landmarks(models, tags):
    """Pages that were not trained on, with these elements as plain divs: 0.95 of the words or more."""
    wanted, found = Counter(), Counter()
    for n, row in enumerate(given_pages()[1::2]):
        plain = re.sub(rf"<(/?)(?:{tags})\b[^>]*>", r"<\1div>", row["html"])
        wanted.update((n, word) for word in by_markup(row["html"]).split())
        found.update((n, word) for word in models[1].extract(plain).split())
    common = (wanted & found).total()
    assert common >= 0.95 * wanted.total() and common >= 0.95 * found.total()


def test_time_grows_in_proportion_to_the_page():
    def took(page):
        start = time.perf_counter()
        html.Page(page)
        return time.perf_counter() - start

    for shape in (lambda n: "<div>" * n + "</span>" * n, lambda n: "<div>" * n + "</b>" * n + "x</div>" * n, lambda n: "<span>" * n + "<p>x" * n, lambda n: "<p>" + "<b>" * n + "<td>" * n + "<h1>" * n):
        assert took(shape(40_000)) < 30 * max(took(shape(5_000)), 0.02)


def test_open_elements_end_where_they_did():
    page = html.Page("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<div>f<p>g<td>h<p>i</div><dl><dt>j<dd>k<dt>l</dl></i>m")
    assert page.tag[1:] == ["ul", "li", "ul", "li", "li", "li", "p", "div", "p", "td", "p", "dl", "dt", "dd", "dt"]
    assert [page.tag[page.parent[n]] for n in range(1, len(page.tag))] == [
        "#page", "ul", "li", "ul", "ul", "ul", "#page", "#page", "div", "p", "td", "#page", "dl", "dl", "dl",
    ]
    assert [text for _, text in page.runs] == list("abcdefghijklm")
