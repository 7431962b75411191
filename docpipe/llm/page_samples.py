"""Pages written at random with their main text marked, to train on.

``data-y="1"`` marks the article, ``data-y="0"`` what does not belong to it.
Layouts differ in elements, class names, order and what surrounds the article.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "ba be di do fa gu ha in ka le mo na or pe qui ra se ti un va we xo yu zel ing ment tion er an the of".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(2, 18).capitalize()
        return text + self.r.choice((".", ".", ".", "!", "?", ""))

    def prose(self, low: int, high: int) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        return text if self.r.random() < 0.85 else " ".join(w + self.r.choice(("", "&amp;", "***", "###")) for w in text.split())

    def attr(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.3:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'

    def links(self, low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.words(1, 4)}</a></{tag}>' for _ in range(self.r.randint(low, high)))

    def wrap(self, tag: str, attr: str, inner: str, mark: str | None = None) -> str:
        y = f' data-y="{mark}"' if mark else ""
        return f"<{tag}{attr}{y}>{inner}</{tag}>"

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        inner = self.links(3, 12) if tag == "ul" else self.r.choice((f"<ul>{self.links(3, 12)}</ul>", self.links(2, 8, "span")))
        attr = self.attr("nav", "menu", "navbar", "breadcrumbs") or (' class="menu"' if tag in ("div", "ul") else "")
        return self.wrap(tag, attr, inner)

    def header(self) -> str:
        inner = f"<h1>{self.words(1, 3)}</h1>" if self.r.random() < 0.4 else f"<p>{self.words(1, 4)}</p>"
        if self.r.random() < 0.5:
            inner += f"<p>{self.sentence()}</p>"
        if self.r.random() < 0.5:
            inner += self.menu()
        tag = self.r.choice(("header", "header", "div"))
        return self.wrap(tag, self.attr("header", "masthead", "site-header", "topbar") or (' class="header"' if tag == "div" else ""), inner)

    def advert(self) -> str:
        inner = self.r.choice((self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f'<a href="/x">{self.sentence()}</a>'))
        return self.wrap(self.r.choice(("div", "div", "aside", "section")), f' class="{self.r.choice(("ad", "ad", "ads", "advert", "sponsored", "promo", "ad-box banner"))}"', inner, "0")

    def notice(self) -> str:
        inner = f"<p>{self.prose(1, 3)}</p>" + self.r.choice(("", "<button>OK</button>", f'<a href="/p">{self.words(1, 3)}</a>'))
        return self.wrap("div", f' {self.r.choice(("class", "id"))}="{self.r.choice(("cookie-notice", "consent", "alert", "popup", "notice", "cookie", "gdpr banner"))}"', inner)

    def side(self) -> str:
        parts = []
        for _ in range(self.r.randint(1, 4)):
            parts.append(self.r.choice((f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 8)}</ul>", f"<h2>{self.words(1, 3)}</h2><p>{self.prose(1, 4)}</p>", self.advert(), f"<p>{self.prose(1, 3)}</p>")))
        tag = self.r.choice(("aside", "aside", "div", "section"))
        return self.wrap(tag, self.attr("sidebar", "widget", "related", "rail") or (' class="sidebar"' if tag != "aside" else ""), "".join(parts))

    def form(self) -> str:
        inner = f"<p>{self.sentence()}</p><label>{self.words(1, 3)}</label><input name=q><select><option>{self.word()}</option></select><button>{self.word()}</button>"
        return self.wrap("form", self.attr("search", "newsletter", "login", "contact"), inner)

    def comments(self) -> str:
        tag = self.r.choice(("div", "li", "article", "section"))
        each = "".join(
            self.wrap(tag, self.attr("comment", "reply"), f"<{self.r.choice(('p', 'h4'))}>{self.words(1, 2)}</p>" * self.r.randint(0, 1) + "".join(f"<p>{self.prose(1, 4)}</p>" for _ in range(self.r.randint(1, 3))))
            for _ in range(self.r.randint(1, 8))
        )
        inner = f"<h3>{self.words(1, 3)}</h3>" * self.r.randint(0, 1) + (f"<ol>{each}</ol>" if tag == "li" else each)
        if self.r.random() < 0.3:
            inner += self.form()
        return self.wrap(self.r.choice(("section", "div")), f' {self.r.choice(("class", "id"))}="{self.r.choice(("comments", "comment-list", "discussion", "comments-area", "replies"))}"', inner, "0")

    def share(self) -> str:
        return self.wrap("div", f' class="{self.r.choice(("share", "social", "sharing tools"))}"', self.links(2, 5, "span"), "0")

    def footer(self) -> str:
        inner = f"&copy; {self.words(1, 3)} &middot; {self.sentence()}"
        if self.r.random() < 0.5:
            inner = f"<p>{inner}</p>" + f"<ul>{self.links(2, 6)}</ul>" * self.r.randint(0, 1)
        tag = self.r.choice(("footer", "footer", "footer", "div"))
        return self.wrap(tag, self.attr("footer", "site-footer", "copyright") or (' class="footer"' if tag == "div" else ""), inner)

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.72:
            return self.r.choice((f"<p>{self.prose(1, 8)}</p>", f"<p>{self.prose(1, 8)}</p>", f"<p><b>{self.prose(1, 3)}<br><p>{self.prose(1, 5)}</p>", f"<p>{self.prose(1, 2)} <a href='/a'>{self.words(1, 4)}</a> {self.prose(1, 2)}"))
        if kind < 0.8:
            return f"<{(h := r.choice(('h2', 'h3')))}>{self.words(1, 8)}</{h}>"
        if kind < 0.86:
            return f"<ul>{''.join(f'<li>{self.sentence()}</li>' for _ in range(r.randint(2, 7)))}</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.95:
            return f"<pre>{self.words(3, 20)}</pre>"
        if kind < 0.97:
            return f"<figure><img src=a.png><figcaption>{self.sentence()}</figcaption></figure>"
        return f"<section>{''.join(f'<p>{self.prose(1, 5)}</p>' for _ in range(r.randint(1, 3)))}</section>"

    def article(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 25)))]
        if r.random() < 0.8:
            title = f"<h1>{self.words(1, 9)}</h1>"
            blocks.insert(0, f"<header>{title}</header>" if r.random() < 0.1 else title)
        for extra in (self.advert, self.share, self.side_note):
            if r.random() < 0.15:
                blocks.insert(r.randint(1, len(blocks)), extra())
        if r.random() < 0.1:
            blocks.append(self.comments())
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        attr = self.attr("content", "article", "post", "entry-content", "story", "main") or (' class="content"' if tag in ("div", "section") and r.random() < 0.8 else "")
        text = self.wrap(tag, attr, "".join(blocks), "1")
        if r.random() < 0.3:
            text = self.wrap(r.choice(("main", "div")), self.attr("main", "container", "wrapper"), text)
        return text

    def side_note(self) -> str:
        return self.wrap("aside", self.attr("related", "sidebar"), f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 5)}</ul>", "0")

    def page(self) -> str:
        r = self.r
        before = [part() for part, chance in ((self.header, 0.5), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.2), (self.side, 0.2)) if r.random() < chance]
        after = [part() for part, chance in ((self.share, 0.2), (self.side, 0.35), (self.comments, 0.35), (self.advert, 0.25), (self.form, 0.2), (self.notice, 0.15)) if r.random() < chance]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join(before) + (self.article() if r.random() < 0.96 else "") + "".join(after) + (self.footer() if r.random() < 0.85 else "")
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body data-y=\"0\"><!-- {self.words(1, 3)} -->{body}" + r.choice(("</body></html>", ""))


def sample_pages(n: int, seed: int) -> Iterator[str]:
    for i in range(n):
        yield _Writer(seed * 1_000_003 + i).page()
