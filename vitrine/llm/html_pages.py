"""Labelled pages: small web pages whose text blocks say whether they are main text.

Pages have no labels of their own, so the field is trained on pages laid out by the
common conventions of the web: semantic elements, or plain divisions named by class
or id, with menus, notices, adverts, forms, sidebars and comments around and inside
the article. ``data-label`` on a block is its label; the features never see it.
"""

from __future__ import annotations

import random

LABEL = "data-label"

#: Usual names of page parts that are not the article.
OTHER_NAMES = (
    "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice",
    "alert", "popup", "modal", "newsletter", "subscribe", "signup", "nav", "navigation", "navbar", "menu", "breadcrumb",
    "breadcrumbs", "toolbar", "header", "masthead", "footer", "sidebar", "widget", "related", "recommended", "share",
    "social", "comment", "comments", "reply", "respond", "discussion", "pagination", "pager", "copyright", "legal",
    "login", "search", "form", "tags", "disclaimer", "topbar")
MAIN_NAMES = ("content", "article", "post", "entry", "story", "main", "body", "text", "page")
SYLLABLES = "ka lo mi ren ta sol ver ni pa du chen or est al in ge mar to bel ri".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        at = self.r.randrange(len(words))
        words[at] += "," if len(words) > 6 else ""
        return " ".join(words).capitalize() + "."

    def prose(self, most: int = 6) -> str:
        text = " ".join(self.sentence(2, 18) for _ in range(self.r.randint(1, most)))
        if self.r.random() < 0.25:  # rows of a table, shouting, stray signs, a cut end
            sign = self.r.choice((" |", "!!", "***", " #", ""))
            text = (sign + " ").join(text.rstrip(".").split(" ")) + sign
        return text

    def leaf(self, tag: str, text: str, label: int, attrs: str = "") -> str:
        return f'<{tag}{attrs} {LABEL}="{label}">{text}</{tag}>'

    def name(self, names: tuple[str, ...]) -> str:
        key = self.r.choice((" class", " class", " id"))
        extra = self.r.choice(("", "", "-box", "-area", " wide"))
        return f'{key}="{self.r.choice(names)}{extra}"'

    def links(self) -> str:
        items = "".join(self.leaf("li", f'<a href="/x">{self.word()}</a>', 0) for _ in range(self.r.randint(2, 7)))
        return f"<ul>{items}</ul>"

    def other(self) -> str:
        """A part that is not the article."""
        kind = self.r.randrange(9)
        name = self.name(OTHER_NAMES)
        if kind == 0:
            return f"<nav>{self.links()}</nav>"
        if kind == 1:
            return f"<div{name}>{self.links()}</div>"
        if kind == 2:
            return self.leaf("div", self.prose(3), 0, name)
        if kind == 3:
            inner = "".join(self.leaf(self.r.choice(("p", "div", "h3")), self.prose(3), 0) for _ in range(2))
            return f"<{self.r.choice(('div', 'section'))}{name}>{inner}</div></section>"
        if kind == 4:
            return f"<aside>{self.leaf('h3', self.word(), 0)}{self.leaf('p', self.prose(3), 0)}{self.links()}</aside>"
        if kind == 5:
            return (f"<form>{self.leaf('label', self.sentence(1, 4), 0)}{self.leaf('button', self.word(), 0)}"
                    f"{self.leaf('p', self.prose(2), 0)}</form>")
        if kind == 6:
            one = "".join(f'<div class="comment">{self.leaf("p", self.prose(3), 0)}</div>' for _ in range(3))
            return f"<section{self.name(('comments', 'comment-list', 'discussion'))}>{self.leaf('h2', self.word(), 0)}{one}</section>"
        if kind == 7:
            return self.leaf("p", f'<a href="/y">{self.sentence(1, 4)}</a>', 0, self.name(OTHER_NAMES))
        return f'<div role="{self.r.choice(("navigation", "complementary", "banner", "search"))}">{self.leaf("p", self.prose(2), 0)}</div>'

    def article(self) -> str:
        parts = [self.leaf("h1", self.sentence(1, 9), 1)] if self.r.random() < 0.8 else []
        for _ in range(self.r.randint(1, 9)):
            kind = self.r.random()
            if kind < 0.75:
                text = self.prose()
                if self.r.random() < 0.25:
                    text += f' <a href="/z">{self.word()}</a> {self.sentence(1, 6)}'
                parts.append(self.leaf("p", f"<b>{text}</b>" if self.r.random() < 0.2 else text, 1))
            elif kind < 0.85:
                parts.append(self.leaf(self.r.choice(("h2", "h3", "blockquote", "pre", "figcaption")), self.sentence(1, 9), 1))
            elif kind < 0.92:
                items = "".join(self.leaf("li", self.sentence(1, 12), 1) for _ in range(3))
                parts.append(f"<{self.r.choice(('ul', 'ol'))}>{items}</ul></ol>")
            else:
                rows = "".join(f"<tr>{self.leaf('td', self.sentence(1, 3), 1)}{self.leaf('td', self.word(), 1)}</tr>" for _ in range(2))
                parts.append(f"<table>{rows}</table>")
            if self.r.random() < 0.1:
                parts.append(self.other())
        inner = "".join(parts)
        kind = self.r.randrange(8)
        if self.r.random() < 0.5:  # plain divisions around it
            inner = "<div>" * 2 + inner + "</div>" * 2
        if kind <= 1:
            return f"<article>{inner}</article>"
        if kind == 2:
            return f"<main>{inner}</main>"
        if kind == 3:
            return f"<div{self.name(MAIN_NAMES)}>{inner}</div>"
        if kind == 4:
            return f"<main><article{self.name(MAIN_NAMES)}>{inner}</article></main>"
        if kind == 5:  # layouts that name nothing: a plain division, the body itself, a cell
            return f"<div>{inner}</div>"
        if kind == 6:
            return inner
        return f"<table><tr><td>{inner}</td></tr></table>"

    def page(self) -> str:
        top = [self.leaf("title", self.sentence(1, 9), 0)]
        head = f"<head><meta charset=\"utf-8\">{top[0]}<style>p{{margin:0}}</style><script>var a=\"<p>\";</script></head>"
        if self.r.random() < 0.35:
            head = ""
        parts = []
        if self.r.random() < 0.4:
            parts.append(f"<header>{self.leaf('h2', self.word(), 0)}{self.leaf('p', self.sentence(1, 6), 0)}</header>")
        parts += [self.other() for _ in range(self.r.randint(0, 3))]
        parts.append(self.article())
        parts += [self.other() for _ in range(self.r.randint(0, 3))]
        if self.r.random() < 0.7:
            parts.append(self.leaf("footer", f"&copy; {self.word()} &middot; {self.prose(2)}", 0))
        if self.r.random() < 0.3:
            parts[:] = [f'<div class="{self.r.choice(("wrapper", "container", "row"))}">', *parts, "</div>"]
        return f"<!DOCTYPE html><html>{head}<body>{''.join(parts)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    return [_Writer(seed * 100_003 + i).page() for i in range(n)]
