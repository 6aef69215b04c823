"""Labelled pages the content model learns from: page parts put together by rule, each part labelled.

An element with ``data-y="0"`` is boilerplate with all that is in it; everything else in the body holds or is
content.  The words are drawn, so that only structure, names and shape of text can be learned.
"""

from __future__ import annotations

import random

_NOT = ' data-y="0"'
_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprstvz"

#: Names in class and id attributes, by the kind of part that uses them.
_NAMES = {
    "menu": ("nav", "menu", "main-menu", "navbar", "topnav", "site-navigation", "breadcrumb", "breadcrumbs", "toc-menu"),
    "head": ("header", "site-header", "masthead", "page-header", "top-bar", "logo", "branding"),
    "foot": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon"),
    "side": ("sidebar", "side", "aside", "widget", "widget-area", "rail", "related", "related-posts", "recommended", "popular", "trending", "tags"),
    "notice": ("cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "banner", "popup", "modal", "overlay"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor"),
    "form": ("form", "search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form"),
    "share": ("share", "social", "share-buttons", "sharing", "follow", "pagination", "pager", "meta-links"),
    "comments": ("comments", "comment-list", "reader-comments", "responses", "disqus", "discussion", "replies", "comment"),
    "content": ("content", "main", "article", "post", "entry", "entry-content", "article-body", "story", "text", "page", "post-content"),
    "plain": ("wrapper", "container", "row", "col", "inner", "box", "section", "block", ""),
}


class _Page:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        r = self.rng
        return "".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(4, 18)
        if self.rng.random() < 0.5:
            text = f"{text}, {self.words(3, 9)}"
        return f"{text.capitalize()}{self.rng.choice('.....!?')}"

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def name(self, kind: str) -> str:
        name = self.rng.choice(_NAMES[kind])
        return f' {self.rng.choice(("class", "class", "id"))}="{name}"' if name else ""

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(
            f'<li><a href="/{self.word()}">{self.words(1, 4)}</a></li>' for _ in range(self.rng.randint(low, high))) + "</ul>"

    def boilerplate(self, kind: str) -> str:
        r = self.rng
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "section")
        # A part carries its meaning in the tag, in a name, or in both.
        tag, name = r.choice(((tag, ""), (tag, self.name(kind)), ("div", self.name(kind)), ("div", self.name(kind))))
        if tag in ("section", "div"):
            name = name or self.name(kind)
        body = {
            "menu": lambda: self.links(2, 9),
            "head": lambda: f"<h1>{self.words(1, 3)}</h1>" + r.choice(("", f"<p>{self.words(2, 7)}</p>", self.links(2, 5))),
            "foot": lambda: r.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 3)}", f"<p>&copy; {self.words(2, 6)}</p>{self.links(2, 5)}", self.links(3, 8))),
            "side": lambda: f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(3, 8), f"<p>{self.prose(1, 3)}</p>", f"<ul><li>{self.words(2, 8)}</li><li>{self.words(2, 8)}</li></ul>")),
            "notice": lambda: r.choice((f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2))) + r.choice(("", f"<button>{self.word()}</button>")),
            "advert": lambda: r.choice((self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f'<a href="/x">{self.words(2, 9)}</a>', f"<h4>{self.words(2, 4)}</h4><p>{self.prose(1, 2)}</p>")),
            "form": lambda: f"<label>{self.words(1, 3)}</label><input><p>{self.words(2, 8)}</p><button>{self.word()}</button>",
            "share": lambda: r.choice((self.links(2, 5), f'<a href="/s">{self.word()}</a> <a href="/t">{self.word()}</a>', f"<p>{self.words(2, 5)}</p>")),
            "comments": lambda: f"<h3>{self.words(1, 3)}</h3>" + "".join(
                r.choice((f"<div><p>{self.words(1, 2)}</p><p>{self.prose(1, 4)}</p></div>", f"<p>{self.prose(1, 4)}</p>", f"<ul><li>{self.prose(1, 3)}</li></ul>"))
                for _ in range(r.randint(1, 4))),
        }[kind]()
        return f"<{tag}{name}{_NOT}>{body}</{tag}>"

    def piece(self) -> str:
        """A block of an article, sometimes with links inside."""
        r = self.rng
        link = f' <a href="/y">{self.words(1, 3)}</a> ' if r.random() < 0.3 else " "
        return r.choices((
            lambda: f"<p>{self.prose(1, 6)}{link}{self.prose(0, 3)}</p>",
            lambda: f"<h2>{self.words(1, 8)}</h2>",
            lambda: f"<ul><li>{self.words(1, 12)}</li><li>{self.sentence()}</li></ul>",
            lambda: f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>",
            lambda: f"<pre>{self.words(2, 20)}</pre>",
            lambda: f"<table><tr><th>{self.word()}</th><td>{self.words(1, 5)}</td></tr><tr><td>{self.word()}</td><td>{self.word()}</td></tr></table>",
            lambda: f"<figure><figcaption>{self.words(2, 9)}</figcaption></figure>",
            lambda: f"<p>{self.words(1, 5)}</p>",
            lambda: f"<div>{self.prose(1, 4)}</div>",
            lambda: f"<ol><li>{self.sentence()}</li><li>{self.words(2, 6)}</li></ol>",
            lambda: f"<dl><dt>{self.word()}</dt><dd>{self.sentence()}</dd></dl>",
        ), (12, 3, 2, 1, 1, 1, 1, 2, 2, 1, 1))[0]()

    def html(self) -> str:
        r = self.rng
        pieces = [self.piece() for _ in range(r.randint(1, 9))]
        if r.random() < 0.35:  # parts that stand inside the article
            pieces.insert(r.randint(0, len(pieces)), self.boilerplate(r.choice(("advert", "share", "side", "notice", "form", "comments", "menu"))))
        if r.random() < 0.15:
            pieces.append(self.boilerplate("comments"))
        title = f"<h1>{self.words(1, 9)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = title + "".join(pieces)
        main = r.choice((
            lambda: f"<article>{inner}</article>", lambda: f"<article{self.name('content')}>{inner}</article>",
            lambda: f"<main><article>{inner}</article></main>", lambda: f"<main>{inner}</main>",
            lambda: f"<div{self.name('content')}>{inner}</div>", lambda: f"<div{self.name('plain')}><div{self.name('content')}>{inner}</div></div>",
            lambda: f"<section>{inner}</section>", lambda: f"<div{self.name('plain')}>{inner}</div>", lambda: inner,
        ))()
        before = "".join(self.boilerplate(k) for k in ("head", "menu", "notice", "advert", "form", "side") if r.random() < 0.35)
        after = "".join(self.boilerplate(k) for k in ("share", "comments", "side", "advert", "foot", "notice", "menu") if r.random() < 0.3)
        for _ in range(r.choice((0, 0, 0, 1, 2, 4, 8))):  # wrappers
            main = f"<div{self.name('plain')}>{main}</div>"
        if r.random() < 0.4:
            main = f"<div{self.name('plain')}>{before}{main}{after}</div>"
            before = after = ""
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{before}{main}{after}</body></html>"


def labelled_pages(n: int = 600, seed: int = 0) -> list[str]:
    """``n`` pages; another seed gives pages to hold out."""
    return [_Page(seed * 1_000_003 + i).html() for i in range(n)]
