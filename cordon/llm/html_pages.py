"""Labelled pages for training, made from several layouts: each element knows whether it is article, not, or around both."""

from __future__ import annotations

import random
from html import escape

WRAP, CONTENT, OTHER = 0, 1, 2
#: Usual names of page parts, as found in public themes and frameworks.
NAMES = {
    "nav": "nav navbar navigation menu main-menu site-nav breadcrumb breadcrumbs topnav sidenav links pagination pager toc".split(),
    "header": "header site-header masthead banner topbar top-bar branding logo page-header hero".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal credits foot".split(),
    "side": "sidebar side aside widget widgets widget-area rail right-col secondary related recommended popular trending more-stories".split(),
    "notice": "cookie cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe signup promo-bar message".split(),
    "ad": "ad ads advert advertisement adsense ad-slot sponsor sponsored promo promotion banner-ad dfp commercial".split(),
    "form": "form search search-form login contact-form subscribe-form poll survey".split(),
    "comments": "comments comment comment-list replies reply discussion disqus responses thread user-comment feedback".split(),
    "share": "share social sharing social-links tags meta byline author-box post-meta tools".split(),
    "body": "content article post entry main story article-body post-content entry-content text story-body body-text".split(),
    "wrap": "page wrapper container wrap site row layout outer inner main-wrap grid col primary".split(),
}
#: Words that page parts other than the article are apt to say.
SAYS = {
    "footer": ["©", "copyright", "all rights reserved", "privacy", "terms", "imprint"],
    "notice": ["cookies", "accept", "consent", "subscribe", "newsletter", "sign up", "please enable"],
    "ad": ["advertisement", "sponsored", "buy now", "offer", "sale"],
    "comments": ["reply", "comments", "says", "posted by", "report abuse"],
    "form": ["search", "login", "password", "submit", "send", "email"],
    "side": ["related", "popular", "read more", "see also", "archive", "tags"],
    "nav": ["home", "about", "contact", "menu", "next", "previous"],
    "share": ["share", "tweet", "published", "by", "min read"],
}
PHRASES = sorted({p for phrases in SAYS.values() for p in phrases})
LETTERS = "etaoinshrdlucmfwypvbgkéüñç"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: Are names of classes and ids invented?
        self.strange = False
        self.words = ["".join(self.r.choices(LETTERS, k=self.r.randint(1, 9))) for _ in range(400)]

    def some(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(lo, hi)))

    def says(self, kind: str, text: str) -> str:
        """text with, mostly, a word that such a part is apt to say."""
        if self.r.random() < 0.7:
            own = self.r.choice(SAYS[kind])
            return f"{own.capitalize()} {text}" if self.r.random() < 0.7 else f"{text} {own}"
        return text

    def quoted(self) -> str:
        """Such a phrase in an article."""
        own = self.r.choice(PHRASES).capitalize()
        return self.r.choice([f"{own}.", f"{own} {self.some(1, 8)}.", f"{self.some(2, 10)} {own}."])

    def sentences(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.r.randint(lo, hi)):
            s = self.some(1, 20)
            if self.r.random() < 0.3:
                s = s.replace(" ", f"{self.r.choice(['%%%', '###', '&&&', ',', ' |'])} ", self.r.randint(1, 9))
            out.append(s.capitalize() + self.r.choice(".....!?"))
        return " ".join(out)

    def link(self, text: str) -> str:
        return f'<a href="/{self.some(1, 1)}">{escape(text)}</a>'

    def name(self, kind: str) -> str:
        own = self.r.choice(NAMES[kind])
        if self.strange:
            return self.r.choice(["", f' class="{self.some(1, 2)}"', f' id="{self.some(1, 1)}"'])
        if self.r.random() < 0.3:
            own += " " + self.r.choice([*NAMES["wrap"], *NAMES[kind]])
        how = self.r.random()
        return f' class="{own}"' if how < 0.6 else f' id="{own}"' if how < 0.8 else f' id="{self.r.choice(NAMES[kind])}" class="{own}"'

    def open(self, tag: str, kind: str | None, label: int) -> str:
        """The label rides along as an attribute that the parser's features do not read."""
        return f"<{tag}{self.name(kind) if kind else ''} data-label=\"{label}\">"

    def box(self, kind: str, tags: list[str], inner: str, named: float = 0.8) -> str:
        tag = self.r.choice(tags)
        plain = {"nav": "nav", "footer": "footer", "header": "header", "side": "aside", "form": "form", "body": "article"}.get(kind)
        return self.open(tag, kind if tag == "div" or tag == "section" or self.r.random() < (named if tag == plain else 0.9) - 0.4 else None, OTHER) + inner + f"</{tag}>"

    def p(self, label: int, text: str, kind: str | None = None, tag: str = "p") -> str:
        end = "" if tag == "p" and self.r.random() < 0.15 else f"</{tag}>"
        return self.open(tag, kind, label) + text + end

    def rich(self, text: str) -> str:
        out = escape(text)
        if self.r.random() < 0.3:
            a, _, b = out.partition(" ")
            out = self.r.choice([f"<b>{a}</b> {b}", f"{a} <em>{b}</em>", f"{self.link(a)} {b}", f"<b>{a} {b}<br>"])
        return out

    def menu(self) -> str:
        items = "".join(self.open("li", None, OTHER) + self.link(self.some(1, 3)) + "</li>" for _ in range(self.r.randint(2, 10)))
        return self.open("ul", "nav" if self.r.random() < 0.2 else None, OTHER) + items + "</ul>"

    def ad(self) -> str:
        return self.box("ad", ["div", "div", "aside", "section"], self.says("ad", self.r.choice([self.some(3, 15), self.p(OTHER, self.says("ad", self.sentences(1, 2))), self.link(self.some(2, 8))])))

    def comments(self) -> str:
        own = []
        for _ in range(self.r.randint(1, 6)):
            body = self.p(OTHER, self.says("comments", self.sentences(1, 4)), tag=self.r.choice(["p", "p", "div"]))
            own.append(self.open(self.r.choice(["div", "li", "article"]), "comments", OTHER) + (self.p(OTHER, self.some(1, 2), "share", "div") if self.r.random() < 0.3 else "") + body + "</div>")
        own = [o[: -len("</div>")] + f"</{o[1 : o.index(' ')]}>" for o in own]
        title = self.p(OTHER, self.says("comments", self.some(1, 2)), tag=self.r.choice(["h2", "h3"]))
        return self.box("comments", ["div", "section", "div", "ul"], title + "".join(own))

    def side(self) -> str:
        parts = [self.p(OTHER, self.says("side", self.some(1, 4)), tag=self.r.choice(["h2", "h3", "h4"])), self.r.choice([self.menu(), self.p(OTHER, self.sentences(1, 3)), self.ad()])]
        return self.box("side", ["aside", "aside", "div", "section"], "".join(parts * self.r.randint(1, 2)))

    def field(self) -> str:
        r = self.r
        options = "".join(self.open("option", None, OTHER) + self.some(1, 2) + "</option>" for _ in range(r.randint(1, 4)))
        return r.choice(['<input type="text">', f"<label>{self.some(1, 3)}</label>", self.open("select", None, OTHER) + options + "</select>", self.p(OTHER, self.says("form", self.some(1, 2)), tag="button")])

    def form(self) -> str:
        return self.box("form", ["form", "form", "div"], self.p(OTHER, self.says("form", self.some(1, 8)), tag=self.r.choice(["p", "div", "legend"])) + "".join(self.field() for _ in range(self.r.randint(1, 3))) + self.p(OTHER, self.says("form", self.some(1, 2)), tag="button"))

    def hidden(self) -> str:
        how = self.r.choice([" hidden", ' hidden=""', ' class="hidden"', ' class="sr-only"'])
        return f'<p{how} data-label="{OTHER}">{self.sentences(1, 2)}</p>'

    def notice(self) -> str:
        return self.box("notice", ["div", "div", "section", "aside", "dialog"], self.r.choice([self.says("notice", self.sentences(1, 3)), self.p(OTHER, self.says("notice", self.sentences(1, 3)))]) + (self.p(OTHER, self.says("notice", self.some(1, 2)), tag="button") if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        return self.box("footer", ["footer", "footer", "div"], self.r.choice(["&copy; " + self.some(1, 8), self.says("footer", self.some(1, 8)), self.p(OTHER, "&copy; " + self.sentences(1, 2)), self.menu() + self.p(OTHER, self.says("footer", self.some(2, 10)))]))

    def header(self) -> str:
        return self.box("header", ["header", "header", "div"], self.r.choice([self.p(OTHER, self.link(self.some(1, 3)), tag=self.r.choice(["h1", "div", "p"])), self.p(OTHER, self.some(1, 6), tag="p"), self.some(1, 5)]) + (self.menu() if self.r.random() < 0.4 else ""))

    def nav(self) -> str:
        return self.box("nav", ["nav", "nav", "div"], self.menu() if self.r.random() < 0.8 else " | ".join(self.link(self.some(1, 2)) for _ in range(self.r.randint(2, 8))))

    def article(self, short: bool = False) -> str:
        r, parts = self.r, []
        if short:
            # a few words, and often something in it that is no article
            parts = [self.p(CONTENT, self.rich(self.some(1, 12)), tag="p") for _ in range(r.randint(1, 2))]
            if r.random() < 0.4:
                parts.insert(0, self.p(CONTENT, self.rich(self.some(1, 6)), tag=r.choice(["h1", "h2"])))
            if r.random() < 0.6:
                parts.insert(r.randint(0, len(parts)), r.choice([self.form, self.hidden, self.field, self.ad, self.comments])())
            tag = r.choice(["article", "article", "article", "main"])
            return self.open(tag, "body" if r.random() < 0.3 else None, CONTENT) + "".join(parts) + f"</{tag}>"
        title = self.p(CONTENT, self.rich(self.some(2, 10)), tag=r.choice(["h1", "h1", "h2"]))
        if r.random() < 0.2:
            title = self.open("header", None, CONTENT) + title + "</header>"
        parts.append(title)
        if r.random() < 0.25:
            parts.append(self.p(OTHER, self.some(2, 6), "share", r.choice(["p", "div"])))
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.06:
                parts.append(self.p(CONTENT, self.quoted()))
            elif k < 0.72:
                parts.append(self.p(CONTENT, self.rich(self.sentences(1, 8))))
            elif k < 0.80:
                parts.append(self.p(CONTENT, self.rich(self.some(1, 8)), tag=r.choice(["h2", "h3", "h4"])))
            elif k < 0.86:
                tag = r.choice(["ul", "ol"])
                parts.append(self.open(tag, None, CONTENT) + "".join(self.p(CONTENT, self.rich(self.some(2, 14)), tag="li") for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif k < 0.90:
                parts.append(self.open("blockquote", None, CONTENT) + self.p(CONTENT, self.sentences(1, 3)) + "</blockquote>")
            elif k < 0.92:
                parts.append(self.p(CONTENT, self.some(3, 20), tag="pre"))
            elif k < 0.94:
                parts.append(self.open("table", None, CONTENT) + "".join(self.open("tr", None, CONTENT) + "".join(self.p(CONTENT, self.some(1, 4), tag="td") for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif k < 0.96:
                parts.append(self.open("figure", None, CONTENT) + "<img>" + self.p(CONTENT, self.some(3, 12), tag="figcaption") + "</figure>")
            elif k < 0.97:
                parts.append(self.ad())
            elif k < 0.98:
                parts.append(r.choice([self.form, self.hidden, self.field])())
            else:
                parts.append(self.box("share", ["div"], self.menu()))
        if r.random() < 0.15:
            parts.append(self.comments())
        body = "".join(parts)
        if r.random() < 0.35:
            body = self.open("div", "body" if r.random() < 0.7 else None, CONTENT) + body + "</div>"
        tag = r.choice(["article", "article", "div", "section", "main"])
        return self.open(tag, "body" if tag == "div" or r.random() < 0.3 else None, CONTENT) + body + f"</{tag}>"

    def bare(self) -> str:
        """Headings and paragraphs without an element around them."""
        r = self.r
        parts = [self.p(CONTENT, self.rich(self.some(2, 8)), tag=r.choice(["h1", "h1", "h2"]))] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 8)):
            parts.append(self.p(CONTENT, self.rich(self.sentences(1, 6) if r.random() < 0.7 else self.some(2, 12)) if r.random() < 0.95 else self.quoted()))
        if r.random() < 0.2:
            parts.insert(r.randint(0, len(parts)), r.choice([self.form, self.hidden, self.ad])())
        return "".join(parts)

    def cells(self) -> str:
        """A table as the page's frame: menu, article and side in cells."""
        r = self.r
        menu = self.open("td", None, OTHER) + (self.menu() if r.random() < 0.5 else " | ".join(self.link(self.says("nav", self.some(1, 2))) for _ in range(r.randint(3, 8)))) + "</td>"
        text = self.open("td", None, CONTENT) + "".join(self.p(CONTENT, self.rich(self.sentences(1, 6)) if r.random() < 0.95 else self.quoted()) for _ in range(r.randint(2, 8))) + "</td>"
        side = self.open("td", None, OTHER) + self.says("side", self.some(1, 6)) + "</td>" if r.random() < 0.4 else ""
        return self.open("table", None, WRAP) + self.open("tr", None, WRAP) + menu + text + side + "</tr></table>"

    def page(self, layout: str) -> str:
        """A page of one of LAYOUTS."""
        r = self.r
        self.strange = layout == "strange"
        before = [f() for f in (self.header, self.nav, self.notice, self.ad, self.form) if r.random() < 0.5]
        after = [f() for f in (self.comments, self.side, self.ad, self.footer, self.notice, self.form) if r.random() < 0.5]
        r.shuffle(before)
        main = {"bare": self.bare, "table": self.cells, "short": lambda: self.article(True)}.get(layout, self.article)()
        if layout not in ("bare", "table") and r.random() < 0.4:
            around = [self.side()] if r.random() < 0.4 else []
            near = self.comments() if r.random() < 0.3 else ""
            main = self.open(r.choice(["div", "main", "section", "div"]), "wrap" if r.random() < 0.7 else None, WRAP) + "".join([main + near, *around][:: r.choice([1, -1])]) + "</div>"
            main = main[: -len("</div>")] + f"</{main[1 : main.index(' ')]}>"
        if layout in ("bare", "short") and r.random() < 0.3:
            before, after = [], []
        body = "".join([*before, main, *after])
        if r.random() < 0.4:
            body = self.open("div", "wrap" if r.random() < 0.8 else None, WRAP) + body + "</div>"
        self.strange = False
        head = f"<head data-label=\"{OTHER}\"><title>{self.some(2, 8)}</title></head>" if r.random() < 0.9 else ""
        if r.random() < 0.1:
            return body
        return f'<!DOCTYPE html><html data-label="{WRAP}">{head}<body data-label="{WRAP}">{body}</body></html>'


#: Usual pages, class names that say nothing, articles of a few words, paragraphs straight in the body, frames of tables.
LAYOUTS = ["usual", "strange", "short", "bare", "table"]


def labelled_pages(n: int, seed: int = 7, layouts: list[str] | None = None) -> list[str]:
    maker, layouts = Maker(seed), layouts or ["usual", *LAYOUTS]
    return [maker.page(layouts[i % len(layouts)]) for i in range(n)]
