"""Labelled pages to train the extraction field on: whole html in many makes, each block of main text marked as such.

A make draws its page frame, the tags and names of its parts and their order; names are left out or
meaningless in a share of the pages, so that the place, shape and links of a block must count as well.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Begins every block of main text; taken off before features are read.
MARK = "\ue000"

#: Names by part, as they occur on the web.
NAMES = {
    "article": "article content post entry-content story-body article__body post-body page-content main-text prose blog-post mw-body",
    "comments": "comments comment-list discussion responses replies disqus_thread feedback reader-comments talkback reviews",
    "side": "sidebar side rail right-col widget-area related recommended most-read trending aside-block teaser more-stories",
    "notice": "cookie-banner consent gdpr-notice notice alert popup modal overlay paywall announcement",
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad adsbygoogle partner",
    "header": "header masthead topbar site-title logo branding site-header",
    "nav": "nav menu navbar navigation breadcrumbs tabs toolbar pagination main-menu skip-links",
    "footer": "footer copyright legal colophon site-info bottom imprint",
    "form": "newsletter subscribe signup search login contact-form",
    "share": "share social share-buttons follow-us tools print",
}
TAGS = {"article": ("article", "div", "div", "main", "section", "td"), "comments": ("section", "div", "ol", "div"), "side": ("aside", "div", "section"), "notice": ("div", "section"), "ad": ("div", "aside", "section"), "header": ("header", "div"), "nav": ("nav", "div", "ul"), "footer": ("footer", "div"), "form": ("form", "div"), "share": ("div", "ul")}


class Writer:
    """Writes one page."""

    def __init__(self, rng: random.Random, named: float, names: dict[str, str] = NAMES):
        self.rng, self.named, self.names = rng, named, names
        self.letters = rng.choice(("etaoinshrdlu", "enisratdhul\u00fc", "esaitnrulo\u00e9", "eaosrnidl\u00f3"))

    def word(self) -> str:
        return "".join(self.rng.choice(self.letters) for _ in range(self.rng.randint(1, 9)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n)).capitalize()

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.rng.randint(3, 18)) + self.rng.choice("....!?") for _ in range(n))

    def prose(self) -> str:
        text = self.sentences(self.rng.choice((1, 1, 2, 3, 6, 9)))
        cut = self.rng.random()
        return self.words(self.rng.randint(1, 2)) + "." if cut < 0.14 else text.replace(" ", f" <a href=/{self.word()}>{self.word()}</a> ", 1) if cut < 0.3 else f"<b>{text}</b>" if cut < 0.4 else text

    def link(self) -> str:
        return f"<a href='/{self.word()}'>{self.words(self.rng.randint(1, 5))}</a>"

    def wrap(self, part: str, inner: str) -> str:
        tag = self.rng.choice(TAGS[part])
        if self.rng.random() < self.named:
            name = self.rng.choice(self.names[part].split())
        else:
            name = self.rng.choice(("", "", "box", "css-" + self.word(), "row", "col inner", "wrapper"))
        attribute = f' {self.rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f"<table><tr><td{attribute}>{inner}</td></tr></table>" if tag == "td" else f"<{tag}{attribute}>{inner}</{tag}>"

    def items(self, tag: str, many: list[str]) -> str:
        inner = "".join(f"<li>{x}</li>" for x in many)
        return f"<{tag}>{inner}</{tag}>"

    def nav(self) -> str:
        return self.wrap("nav", self.items("ul", [self.link() for _ in range(self.rng.randint(2, 9))]) if self.rng.random() < 0.7 else " | ".join(self.link() for _ in range(self.rng.randint(2, 6))))

    def header(self) -> str:
        return self.wrap("header", f"<p>{self.words(2)}</p>" + (self.nav() if self.rng.random() < 0.5 else self.link()))

    def ad(self) -> str:
        text = self.sentences(self.rng.randint(1, 2))
        return self.wrap("ad", text if self.rng.random() < 0.5 else f"<p>{text}</p>{self.link()}")

    def notice(self) -> str:
        return self.wrap("notice", f"<p>{self.sentences(self.rng.randint(1, 2))}</p><button>{self.word()}</button>{self.link()}")

    def form(self) -> str:
        return self.wrap("form", f"<p>{self.words(4)}</p><label>{self.word()}</label><input name=q><button>{self.word()}</button>")

    def share(self) -> str:
        return self.wrap("share", " ".join(self.link() for _ in range(3)))

    def side(self) -> str:
        kind = self.rng.random()
        head = f"<{(h := self.rng.choice(('h2', 'h3', 'h4', 'p')))}>{self.words(2)}</{h}>"
        if kind < 0.5:
            return self.wrap("side", head + self.items("ul", [self.link() for _ in range(self.rng.randint(2, 6))]))
        return self.wrap("side", head + "".join(f"<p>{self.sentences(self.rng.randint(1, 2))}</p>" + (self.link() if kind < 0.8 else "") for _ in range(self.rng.randint(1, 3))))

    def comments(self) -> str:
        out = [f"<h3>{self.rng.randint(1, 90)} {self.word()}</h3>"] if self.rng.random() < 0.7 else []
        many = []
        for _ in range(self.rng.randint(1, 6)):
            by = self.rng.choice((f"<span>{self.word()}</span> <time>{self.rng.randint(1, 28)}.{self.rng.randint(1, 12)}.</time><br>", f"<div>{self.word()}</div>", f"<p><b>{self.word()}</b></p>", ""))
            many.append(f"{by}<p>{self.sentences(self.rng.randint(1, 3))}</p>" + (self.link() if self.rng.random() < 0.4 else ""))
        out.append(self.items("ol", many) if self.rng.random() < 0.4 else "".join(self.wrap("comments", x).replace("<ol", "<div").replace("</ol", "</div") if self.rng.random() < 0.6 else f"<div>{x}</div>" for x in many))
        if self.rng.random() < 0.4:
            out.append(self.form())
        return self.wrap("comments", "".join(out))

    def footer(self) -> str:
        text = f"&copy; {self.word()} {self.words(3)}" if self.rng.random() < 0.6 else self.sentences(1)
        return self.wrap("footer", self.rng.choice((text, f"<p>{text}</p>")) + (self.link() if self.rng.random() < 0.5 else ""))

    def main_block(self) -> str:
        kind, p = self.rng.random(), self.prose
        if kind < 0.68:
            return f"<p>{MARK}{p()}" + ("</p>" if self.rng.random() < 0.9 else "")
        if kind < 0.76:
            return f"<{(h := self.rng.choice(('h2', 'h3')))}>{MARK}{self.words(3)}</{h}>"
        if kind < 0.86:
            return self.items(self.rng.choice(("ul", "ol")), [MARK + self.rng.choice((self.words(4), p())) for _ in range(self.rng.randint(1, 4))])
        if kind < 0.91:
            return f"<blockquote>{self.rng.choice(('', '<p>'))}{MARK}{self.sentences(1)}</blockquote>"
        if kind < 0.94:
            return f"<table><tr><td>{MARK}{self.word()}</td><td>{MARK}{self.word()}</td></tr></table>"
        return f"<pre>{MARK}{self.words(6)}</pre>" if kind < 0.97 else f"<figure><img src=x><figcaption>{MARK}{self.words(6)}</figcaption></figure>"

    def article(self) -> str:
        rng = self.rng
        parts = [f"<h1>{MARK}{self.words(rng.randint(2, 9))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 4, 8, 12))):
            parts.append(self.main_block())
            if rng.random() < 0.2:
                parts.append(rng.choice((self.ad, self.share, self.side, self.form))())
        inside = "".join(parts) + "".join(f() for f, odds in ((self.share, 0.2), (self.side, 0.2), (self.comments, 0.25)) if rng.random() < odds)
        return self.wrap("article", f"<div>{inside}</div>" if rng.random() < 0.2 else inside)

    def page(self) -> str:
        rng = self.rng
        before = [f() for f, odds in ((self.header, 0.6), (self.nav, 0.7), (self.notice, 0.3), (self.ad, 0.4), (self.side, 0.15)) if rng.random() < odds]
        after = [f() for f, odds in ((self.share, 0.2), (self.comments, 0.4), (self.side, 0.4), (self.ad, 0.2), (self.form, 0.3), (self.notice, 0.1), (self.footer, 0.9)) if rng.random() < odds]
        rng.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if rng.random() < 0.3:
            body = f"<div id=page><div class=container>{body}</div></div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(3)}</title><style>p{{}}</style></head><body>{body}<script>var x='</p>';</script></body></html>"


def pages(n: int, seed: int, names: dict[str, str] = NAMES) -> Iterator[str]:
    """``n`` pages; names are telling in most of them, in some of them and in few of them by turns."""
    rng = random.Random(seed)
    for i in range(n):
        yield Writer(rng, (0.95, 0.7, 0.3)[i % 3], names).page()
