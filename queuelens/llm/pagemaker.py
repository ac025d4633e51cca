"""Labelled training pages for the content model: made pages of many layouts, each leaf block with its label.

The words are random syllables, so that the model learns layout and not vocabulary. ``pages(n, seed)`` gives
(html, labels) with a label per leaf block in page order (1: main text).
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha li mo nu pe ra so ti ve wo ya ze or an en".split()
MENU_CLASSES = ["nav", "menu", "navbar", "topnav", "breadcrumbs", "site-nav", "main-menu", "pagination", "tabs"]
SIDE_CLASSES = ["sidebar", "related", "widget", "recommended", "side", "trending", "newsletter", "subscribe", "share",
                "social", "tags"]
NOTICE_CLASSES = ["cookie", "cookie-banner", "consent", "notice", "gdpr", "popup", "modal", "alert", "banner"]
AD_CLASSES = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adbox"]
COMMENT_CLASSES = ["comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses"]
FOOT_CLASSES = ["footer", "site-footer", "copyright", "legal", "bottom"]
HEAD_CLASSES = ["header", "masthead", "site-header", "logo", "top"]
BODY_CLASSES = ["content", "article", "post", "entry", "story", "main", "article-body", "post-content", "text"]


class Maker:
    def __init__(self, rng: random.Random):
        self.rng, self.labels = rng, []

    def words(self, least: int, most: int) -> str:
        return " ".join("".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4)))
                        for _ in range(self.rng.randint(least, most)))

    def sentence(self, least: int = 4, most: int = 30) -> str:
        return self.words(least, most).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def block(self, tag: str, text: str, label: int, attrs: str = "") -> str:
        self.labels.append(label)
        return f"<{tag}{attrs}>{text}</{tag}>"

    def named(self, tag: str, classes: list[str], inner: str) -> str:
        return f'<{tag} {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(classes)}">{inner}</{tag}>'

    def links(self, n: int, label: int = 0) -> str:
        item = lambda: self.block("li", f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>', label)
        return "<ul>" + "".join(item() for _ in range(n)) + "</ul>"

    def prose(self, n: int, label: int) -> str:
        out = []
        for _ in range(n):
            text = " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 1, 2, 4, 7])))
            kind = self.rng.random()
            if kind < 0.1:
                text = f"<b>{text}<br>"
            elif kind < 0.25:
                text = text.replace(" ", f' <a href="/x">{self.words(1, 2)}</a> ', 1)
            elif kind < 0.32:
                text = self.words(1, 4)
            if self.rng.random() < 0.08:
                text += " &copy; " + self.words(1, 3)
            if self.rng.random() < 0.04:
                text += " <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></math> " + self.sentence(2, 6)
            out.append(self.block("p", text, label))
        return "".join(out)

    def menu(self) -> str:
        inner = self.links(self.rng.randint(2, 9))
        return f"<nav>{inner}</nav>" if self.rng.random() < 0.6 else self.named("div", MENU_CLASSES, inner)

    def head(self) -> str:
        inner = self.block(self.rng.choice(["div", "p", "span", "h2"]), self.words(1, 5), 0)
        return f"<header>{inner}</header>" if self.rng.random() < 0.6 else self.named("div", HEAD_CLASSES, inner)

    def foot(self) -> str:
        if self.rng.random() < 0.5:
            self.labels.append(0)
            inner = self.rng.choice(["&copy; ", "", "Copyright "]) + f"{self.words(1, 3)} &middot; {self.sentence(2, 14)}"
        else:
            inner = self.block("p", "&copy; 2020 " + self.words(2, 8), 0) + self.links(self.rng.randint(1, 4))
        return f"<footer>{inner}</footer>" if self.rng.random() < 0.7 else self.named("div", FOOT_CLASSES, inner)

    def advert(self) -> str:
        if self.rng.random() < 0.6:
            self.labels.append(0)
            return self.named("div", AD_CLASSES, self.sentence(2, 16))
        return self.named(self.rng.choice(["div", "aside", "section"]), AD_CLASSES, self.prose(1, 0))

    def side(self) -> str:
        inner = self.block("h3", self.words(1, 3), 0) + (
            self.links(self.rng.randint(2, 6)) if self.rng.random() < 0.6 else self.prose(self.rng.randint(1, 2), 0))
        return f"<aside>{inner}</aside>" if self.rng.random() < 0.5 else self.named("div", SIDE_CLASSES, inner)

    def notice(self) -> str:
        if self.rng.random() < 0.5:
            self.labels.append(0)
            return self.named("div", NOTICE_CLASSES, self.sentence(4, 20))
        return self.named("div", NOTICE_CLASSES, self.prose(1, 0) + self.block("button", self.words(1, 2), 0))

    def without_script(self) -> str:
        self.labels.append(0)
        return f"<noscript>{self.sentence(3, 14)}</noscript>"

    def form(self) -> str:
        return "<form>" + self.block("label", self.words(1, 3), 0) + "<input type=text>" + self.block(
            "button", self.words(1, 2), 0) + "</form>"

    def comments(self) -> str:
        inner = self.block("h3", self.words(1, 2), 0) if self.rng.random() < 0.6 else ""
        for _ in range(self.rng.randint(1, 4)):
            kind = self.rng.random()
            if kind < 0.5:
                inner += self.named("div", ["comment", "reply", "comment-body"], self.prose(1, 0))
            else:
                inner += self.prose(1, 0)
        return self.named(self.rng.choice(["section", "div"]), COMMENT_CLASSES, inner)

    def maybe(self, chance: float, make) -> str:
        return make() if self.rng.random() < chance else ""

    def page(self) -> str:
        rng = self.rng
        title = self.sentence(3, 14)
        before = [self.maybe(0.5, self.head), self.maybe(0.85, self.menu), self.maybe(0.25, self.notice),
                  self.maybe(0.15, self.form), self.maybe(0.45, self.advert), self.maybe(0.15, self.side),
                  self.maybe(0.1, self.without_script)]
        body = self.block("h1", title, 1) if rng.random() < 0.85 else ""
        for _ in range(rng.randint(1, 4)):
            body += self.prose(rng.randint(1, 6), 1)
            kind = rng.random()
            if kind < 0.12:
                body += self.block("h2", self.words(2, 6), 1)
            elif kind < 0.2:
                body += "<ul>" + "".join(self.block("li", self.sentence(3, 14), 1) for _ in range(rng.randint(2, 4))) + "</ul>"
            elif kind < 0.26:
                self.labels.append(1)
                body += f"<blockquote>{self.sentence()}</blockquote>"
            elif kind < 0.38:
                body += self.advert()
            elif kind < 0.44:
                body += self.side()
            elif kind < 0.48:
                body += self.form()
        if rng.random() < 0.1:
            body += self.comments()
        place = rng.random()
        if place < 0.5:
            body = f"<article>{body}</article>"
        elif place < 0.65:
            body = f"<main>{body}</main>"
        elif place < 0.85:
            body = self.named(rng.choice(["div", "section"]), BODY_CLASSES, body)
        elif place < 0.95:
            body = f"<main><article>{body}</article></main>"
        after = [self.maybe(0.25, self.comments), self.maybe(0.25, self.side), self.maybe(0.2, self.advert),
                 self.maybe(0.12, self.form), self.maybe(0.12, self.notice), self.maybe(0.05, self.without_script),
                 self.maybe(0.85, self.foot)]
        return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t=\"</p>\";</script>"
                f"</head><body>{''.join(before)}{body}<!-- end -->{''.join(after)}</body></html>")


def pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    out = []
    for k in range(n):
        maker = Maker(random.Random(f"{seed}/{k}"))
        html = maker.page()
        out.append((html, maker.labels))
    return out
