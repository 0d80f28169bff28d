"""Labelled pages to train the extraction model on: invented layouts whose blocks are known to be content or not."""

from __future__ import annotations

import random

_CONTENT = ["content", "article-body", "post", "entry-content", "story", "main-text", "articleBody", "post-content", "text", "page-body"]
_NAV = ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "top-nav", "toc-nav", "pagination"]
_HEAD = ["header", "site-header", "masthead", "topbar", "page-header-bar", "logo"]
_FOOT = ["footer", "site-footer", "copyright", "legal", "bottom-links", "foot"]
_SIDE = ["sidebar", "widget", "related", "right-rail", "recommended", "popular", "aside"]
_AD = ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad", "advertisement"]
_NOTICE = ["cookie-notice", "notice", "consent", "alert", "gdpr-banner", "newsletter", "popup", "subscribe-box", "modal", "announcement"]
_COMMENT = ["comments", "comment", "reader-comments", "reply", "discussion", "comment-list", "respond"]
_FORM = ["search-form", "login", "contact-form", "signup", "feedback"]
_SHARE = ["share", "social", "follow-us", "share-buttons"]


class _Page:
    """Writes html and keeps, in order of opening block tags, whether each is content."""

    def __init__(self, r: random.Random):
        self.r, self.out, self.labels = r, [], []
        self.style = r.choice(["plain"] * 7 + ["terse", "long", "piped"])
        self.vocab = ["".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiouäéñ") for _ in range(r.choice([1, 1, 2, 2, 3, 4]))) for _ in range(300)]

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        w = [self.r.choice(self.vocab) + (self.r.choice([".", ",", "", "", "", "!", "###", "&amp;"]) if self.r.random() < 0.2 else "") for _ in range(n)]
        return " ".join(w).capitalize()

    def open(self, tag: str, label: int, names=None, chance: float = 0.7) -> None:
        at = ""
        if names and self.r.random() < chance:
            at = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'
        self.out.append(f"<{tag}{at}>")
        self.labels.append(label)

    def close(self, tag: str) -> None:
        if not (tag in ("p", "li") and self.r.random() < 0.15):
            self.out.append(f"</{tag}>")

    def leaf(self, tag: str, label: int, text: str) -> None:
        self.open(tag, label)
        self.out.append(text)
        self.close(tag)

    def links(self, n: int) -> None:
        tag = self.r.choice(["ul", "ul", "div", "ol"])
        self.open(tag, 0)
        for _ in range(n):
            a = f'<a href="/{self.r.choice(self.vocab)}">{self.words(1, 3)}</a>'
            if tag == "div":
                self.out.append(a + self.r.choice([" ", " | "]))
            else:
                self.leaf("li", 0, a)
        self.close(tag)

    def prose(self) -> None:
        k = self.r.random()
        if self.style != "plain":
            t = self.words(1, 6) if self.style == "terse" else self.words(3, 150)
            if self.style == "piped":
                t = t.replace(" ", " | ")
            self.leaf("p", 1, t)
        elif k < 0.7:
            t = self.words(1, 8) if self.r.random() < 0.25 else self.words(10, 120)
            if self.r.random() < 0.2:
                t = "<b>" + t + self.r.choice(["</b>", "<br>", ""])
            if self.r.random() < 0.15:
                t += f' <a href="/x">{self.words(1, 4)}</a> ' + self.words(2, 9)
            self.leaf("p", 1, t)
        elif k < 0.8:
            self.leaf(self.r.choice(["h2", "h3"]), 1, self.words(2, 7))
        elif k < 0.88:
            tag = self.r.choice(["ul", "ol"])
            self.open(tag, 1)
            for _ in range(self.r.randint(2, 6)):
                self.leaf("li", 1, self.words(2, 25))
            self.close(tag)
        elif k < 0.93:
            self.leaf(self.r.choice(["blockquote", "pre"]), 1, self.words(5, 50))
        elif k < 0.97:
            self.open("table", 1)
            for _ in range(self.r.randint(1, 4)):
                self.open("tr", 1)
                for _ in range(2):
                    self.leaf("td", 1, self.words(1, 6))
                self.close("tr")
            self.close("table")
        else:
            self.open("div", 1)
            self.out.append(self.words(10, 60))
            self.close("div")

    def boilerplate(self, kind: str) -> None:
        r = self.r
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            self.open(tag, 0, _NAV, 0.3 if tag == "nav" else 1.0)
            self.links(r.randint(3, 10))
            self.close(tag)
        elif kind == "header":
            tag = r.choice(["header", "header", "div"])
            self.open(tag, 0, _HEAD, 0.4 if tag == "header" else 1.0)
            self.leaf(r.choice(["div", "h1", "p", "h2"]), 0, self.words(1, 5))
            if r.random() < 0.5:
                self.boilerplate("nav")
            if r.random() < 0.4:
                self.leaf("p", 0, self.words(3, 15))
            self.close(tag)
        elif kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            self.open(tag, 0, _FOOT, 0.4 if tag == "footer" else 1.0)
            if r.random() < 0.5:
                self.out.append("&copy; " + self.words(2, 12))
            if r.random() < 0.5:
                self.links(r.randint(2, 6))
            if r.random() < 0.5:
                self.leaf("p", 0, self.words(3, 30))
            self.close(tag)
        elif kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            self.open(tag, 0, _SIDE, 0.4 if tag == "aside" else 1.0)
            self.leaf(r.choice(["h3", "h2", "h4", "div"]), 0, self.words(1, 4))
            if r.random() < 0.6:
                self.links(r.randint(2, 8))
            if r.random() < 0.6:
                self.leaf(r.choice(["p", "div"]), 0, self.words(3, 50))
            self.close(tag)
        elif kind in ("ad", "notice", "share"):
            tag = r.choice(["div", "div", "section", "aside", "p"])
            self.open(tag, 0, {"ad": _AD, "notice": _NOTICE, "share": _SHARE}[kind], 1.0)
            if tag == "p" or r.random() < 0.4:
                self.out.append(self.words(2, 40))
            else:
                self.leaf("p", 0, self.words(3, 50))
                if r.random() < 0.4:
                    self.out.append(f"<button>{self.words(1, 2)}</button>")
            self.close(tag)
        elif kind == "form":
            tag = r.choice(["form", "form", "div"])
            self.open(tag, 0, _FORM, 0.5 if tag == "form" else 1.0)
            self.leaf(r.choice(["p", "div"]), 0, self.words(1, 12))
            self.out.append('<input type="text"><button>Go</button>')
            self.close(tag)
        elif kind == "comments":
            tag = r.choice(["section", "div", "ol", "aside"])
            self.open(tag, 0, _COMMENT, 1.0)
            if tag != "ol" and r.random() < 0.7:
                self.leaf(r.choice(["h3", "h2"]), 0, self.words(1, 3))
            for _ in range(r.randint(1, 5)):
                inner = "li" if tag == "ol" else r.choice(["div", "article", "div"])
                self.open(inner, 0, _COMMENT, 0.6)
                self.leaf("p", 0, self.words(4, 60))
                if r.random() < 0.3:
                    self.leaf("p", 0, self.words(2, 30))
                self.close(inner)
            self.close(tag)

    def some(self, kinds: list[str], chance: float) -> None:
        for kind in kinds:
            if self.r.random() < chance:
                self.boilerplate(kind)

    def make(self) -> tuple[str, list[int]]:
        r = self.r
        self.out.append("<!DOCTYPE html>")
        self.open("html", 1)
        self.out.append("<head><title>" + self.words(2, 8) + "</title><style>p{}</style></head>")
        self.open("body", 1)
        shells = []
        if r.random() < 0.4:
            tag = r.choice(["div", "div", "form"])
            self.open(tag, 1, ["wrapper", "page", "container", "site"], 0.7)
            shells.append(tag)
        self.some(r.sample(["notice", "header", "nav", "ad", "form"], 5), 0.45)
        if r.random() < 0.3:
            self.open("div", 1, ["main", "row", "columns", "layout"], 0.6)
            shells.append("div")
        if r.random() < 0.3:
            self.boilerplate("side")
        tag = r.choice(["article", "article", "main", "div", "section", "td"])
        if tag == "td":
            self.open("table", 1)
            self.open("tr", 1)
        named = tag in ("article", "main")
        self.open(tag, 1, _CONTENT, 0.4 if named else 0.9)
        if r.random() < 0.7:
            self.leaf("h1", 1, self.words(2, 9))
        for _ in range(r.choice([1, 2, 3, 6, 10, 16] if self.style == "plain" else [1, 4, 12, 40])):
            self.prose()
            if r.random() < 0.06:
                self.boilerplate(r.choice(["ad", "share", "notice", "side", "form"]))
        inside = r.random() < 0.25
        if inside:
            self.boilerplate("comments")
        self.close(tag)
        if tag == "td":
            self.close("tr")
            self.close("table")
        self.some(r.sample(["side", "ad", "share", "form", "nav"], 5), 0.3)
        if not inside and r.random() < 0.4:
            self.boilerplate("comments")
        self.some(["footer"], 0.75)
        if r.random() < 0.2:
            self.boilerplate("notice")
        for tag in reversed(shells):
            self.close(tag)
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """(html, label of each block element in order of its opening tag)."""
    r = random.Random(seed)
    return [_Page(r).make() for _ in range(n)]
