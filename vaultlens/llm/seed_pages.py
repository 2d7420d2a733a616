"""Labelled pages to train HTML extraction on: usual layouts, written out by rule.

``data-main`` marks content (1) and what is not (0); a node without it has its
parent's label.
"""

from __future__ import annotations

from collections.abc import Iterator

_SHORT = "Yes."
_LINE = "The river rose again in the night."
_TEXT = (
    "The river rose again in the night, and by the morning the lower road was under water. People carried what they "
    "could to the school, where the doors had been open since the first warning came over the radio."
)

#: Places of the main text: start and end tags.
_MAIN = [
    ('<article data-main="1">', "</article>"),
    ('<main data-main="1">', "</main>"),
    ('<main data-main="1"><article class="post">', "</article></main>"),
    ('<div id="content" data-main="1">', "</div>"),
    ('<div class="main-content" data-main="1">', "</div>"),
    ('<section class="article-body" data-main="1">', "</section>"),
    ('<div class="wrap"><div class="entry" data-main="1">', "</div></div>"),
    ('<div data-main="1">', "</div>"),
]

_BODY = [
    f"<h1>{_LINE}</h1><p>{_TEXT}</p><p>{_SHORT}</p><p>{_LINE}</p><p>{_TEXT}</p>",
    f"<h1>{_LINE}</h1><p><b>{_LINE}</b></p><p>{_TEXT} <a href='/x'>{_LINE}</a></p><ul><li>{_LINE}</li><li>{_SHORT}</li></ul>",
    f"<h2>{_SHORT}</h2><p>{_TEXT}</p><blockquote><p>{_LINE}</p></blockquote><h3>{_SHORT}</h3><p>{_TEXT}</p><pre>{_LINE}</pre>",
    f"<p>{_LINE}</p><table><tr><th>{_SHORT}</th><td>{_LINE}</td></tr></table><figure><figcaption>{_LINE}</figcaption></figure>",
    f"<div><p>{_TEXT}</p></div><section><h2>{_SHORT}</h2><p>{_TEXT}</p></section><ol><li>{_TEXT}</li></ol>",
    f"<p>{_LINE}</p>",
    f"<div>{_TEXT}<br>{_LINE}</div><p>{_TEXT}</p>",
]

#: Names with a word of a kind that do not tell it: parts of a text, and parts beside it.
_HINTS = "ad nav header footer sidebar comments notice form share legal".split()

_LINKS = "".join(f'<li><a href="/{n}">{word}</a></li>' for n, word in enumerate("Home News Sport Weather About".split()))

#: What is not main text, wherever it stands.
_OTHER = [
    f'<nav data-main="0"><ul>{_LINKS}</ul></nav>',
    f'<div class="menu" data-main="0"><ul>{_LINKS}</ul></div>',
    f'<ul class="breadcrumbs" data-main="0">{_LINKS}</ul>',
    f'<header data-main="0"><p>{_SHORT}</p><p>{_LINE}</p></header>',
    f'<header data-main="0"><h1>{_SHORT}</h1></header>',
    f'<div class="masthead" data-main="0"><a href="/">{_SHORT}</a><p>{_LINE}</p></div>',
    f'<footer data-main="0"><p>{_LINE}</p>{_TEXT}</footer>',
    f'<footer data-main="0">{_LINE}</footer>',
    f'<div id="footer" data-main="0">{_LINE}<p>{_SHORT}</p></div>',
    f'<aside data-main="0">{_LINE}</aside>',
    f'<aside data-main="0"><h3>{_SHORT}</h3><p>{_TEXT}</p></aside>',
    f'<div class="sidebar" data-main="0"><h3>{_SHORT}</h3><p>{_TEXT}</p><ul>{_LINKS}</ul></div>',
    f'<div class="ad" data-main="0">{_LINE}</div>',
    f'<div class="advert" data-main="0"><p>{_TEXT}</p></div>',
    f'<div class="cookie-notice" data-main="0"><p>{_TEXT}</p></div>',
    f'<div class="notice" data-main="0">{_LINE}</div>',
    f'<form data-main="0"><label>{_SHORT}</label><p>{_LINE}</p></form>',
    f'<div class="newsletter" data-main="0"><p>{_LINE}</p></div>',
    f'<div class="comments" data-main="0"><h3>{_SHORT}</h3><div class="comment"><p>{_TEXT}</p></div><p>{_LINE}</p></div>',
    f'<section class="comments" data-main="0"><h2>{_SHORT}</h2><p>{_LINE}</p></section>',
    f'<div id="sidebar" data-main="0"><p>{_LINE}</p></div>',
    f'<form data-main="0">{_LINE}<input></form>',
    f'<section id="comments" data-main="0"><ol><li><p>{_TEXT}</p></li><li>{_LINE}</li></ol></section>',
    f'<section id="comments" data-main="0"><article class="comment"><p>{_TEXT}</p></article></section>',
    f'<div class="related" data-main="0"><ul>{_LINKS}</ul></div>',
    f'<div class="share" data-main="0"><a href="/s">{_SHORT}</a></div>',
]


def seed_pages() -> Iterator[tuple[str, int]]:
    """Pages with the label of the page itself: every place with every other part, and bare texts."""
    turn = 0
    for start, end in _MAIN:
        for other in _OTHER:
            body = _BODY[turn % len(_BODY)]
            around = [_OTHER[(turn + 7 * k) % len(_OTHER)] for k in range(1, 5)]
            middle = body.index("<p>") if turn % 2 else len(body)
            yield (
                f"<html><body>{around[0]}{around[1]}{start}{body[:middle]}{other}{body[middle:]}{end}"
                f"{around[2]}{around[3]}</body></html>",
                0,
            )
            turn += 1
    for start, end in _MAIN:
        for body in (_SHORT, _LINE, _TEXT, f"<p>{_SHORT}</p>", f"<h1>{_SHORT}</h1><p>{_LINE}</p>"):
            yield f"<html><body>{_OTHER[turn % len(_OTHER)]}{start}{body}{end}{_OTHER[-1 - turn % 5]}</body></html>", 0
            turn += 1
    yield from _plain_pages()
    yield from _hinted_pages()
    for other in _OTHER:
        for body in _BODY[:2]:
            yield f'<html><body data-main="1">{body}{other}</body></html>', 0
            yield f"{body}{other}", 1
            yield f"<div><div>{body}</div>{other}</div>", 1
    for body in (*_BODY, _TEXT, _LINE, _SHORT):
        yield body, 1


def _plain_pages() -> Iterator[tuple[str, int]]:
    """Pages without a name or a landmark: links, text, and who owns the page."""
    anchors = " ".join(f'<a href="/{n}">{word}</a>' for n, word in enumerate("Home News Sport".split()))
    bars = [f"<ul>{_LINKS}</ul>", anchors, anchors.replace(" <a", " | <a"), '<a href="/">Home</a>']
    ends = ["Copyright 2020 The Paper. All rights reserved.", "&copy; 2021 The Paper", f'{anchors} (c) 2022 The Paper']
    for n, bar in enumerate(bars):
        for m, end in enumerate(ends):
            for k, body in enumerate((*_BODY, _TEXT, _LINE, f"{_LINE} {_LINE} {_LINE}")):
                text = f'<div data-main="1">{body}</div>' * (1 + (n + m + k) % 2)
                rows = f"<div>{bar}</div>{text}<div>{end}</div>"
                yield f"<html><body>{rows if k % 2 else f'<div>{rows}</div>'}</body></html>", 0
                cells = [f"<td>{bar}</td>", f'<td data-main="1">{body}</td>', f"<td>{end}</td>"]
                yield f"<table><tr>{('</tr><tr>' if k % 2 else '').join(cells)}</tr></table>", 0


def _hinted_pages() -> Iterator[tuple[str, int]]:
    for n, hint in enumerate(_HINTS):
        for m, (start, end) in enumerate(_MAIN):
            body = _BODY[(n + m) % len(_BODY)]
            inner = f'<section class="{hint}-prices"><h2>{_SHORT}</h2><p>{_TEXT}</p></section><p id="on-{hint}">{_TEXT}</p>'
            outer = f'<div class="acme-{hint}" data-main="0"><h3>{_SHORT}</h3><p>{_TEXT}</p></div>'
            yield f"<html><body>{outer}{start}{body}{inner if m % 2 else ''}{end}{outer}</body></html>", 0
