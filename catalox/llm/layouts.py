"""Generated pages with known regions, for training: ``data-k="1"`` marks content and ``data-k="0"`` everything else."""

from __future__ import annotations

import numpy as np

SYLLABLES = "ba co de fi ga he in jo ka lu me no op pa re sa ti un vo we er an st ou".split()

# Attribute values of regions as sites write them; '' stands for none.
NAMES = {
    "content": ["content", "article-body", "post", "entry-content", "story", "main-content", "post-content", "text", "blog-post", "articleBody", "", "", ""],
    "nav": ["nav", "menu", "main-menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "site-nav", "tabs", "pagination", ""],
    "header": ["header", "masthead", "site-header", "top-bar", "branding", "page-header", ""],
    "footer": ["footer", "site-footer", "bottom", "legal", "copyright", "colophon", ""],
    "side": ["sidebar", "side", "related", "widget", "rail", "related-posts", "trending", "more-stories", "recommended", ""],
    "ad": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement", "adbox", "ad-container"],
    "notice": ["cookie-banner", "cookie-notice", "notice", "consent", "gdpr", "popup", "alert", "newsletter", "subscribe-box", "modal", "privacy-notice", "notification"],
    "comments": ["comments", "comment-list", "discussion", "replies", "reader-comments", "disqus_thread", "comment", "responses"],
    "form": ["login-form", "search", "signup", "contact-form", "search-form", "register", ""],
    "share": ["share", "social", "share-buttons", "follow-us", "post-tags", "sharing", "toolbar"],
}
TAGS = {
    "content": ["article", "article", "main", "div", "section", "div"], "nav": ["nav", "nav", "div", "ul", "div"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
    "side": ["aside", "aside", "div", "section"], "ad": ["div", "div", "aside", "section", "p"], "notice": ["div", "div", "section", "aside", "p"], "comments": ["section", "div", "div", "ol", "aside"],
    "form": ["form"], "share": ["div", "ul"],
}


class Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.plain = rng.random() < 0.25  # a site whose attributes say nothing but for what cannot be told otherwise
        self.sloppy = rng.random() * 0.8 if rng.random() < 0.4 else 0.0  # how often end tags are left out

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def often(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.one(SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(a, b + 1))))

    def sentence(self, a: int = 4, b: int = 22) -> str:
        text = self.words(a, b).capitalize()
        return (text.replace(" ", ", ", 1) if self.often(0.3) else text) + self.one([".", ".", ".", "!", "?"])

    def end(self, tag: str) -> str:
        """An end tag that HTML lets authors leave out."""
        return "" if self.often(self.sloppy) else f"</{tag}>"

    def inline(self, text: str) -> str:
        tag = self.one(["b", "i", "em", "strong", "span", "u", "code", "font"])
        return f"<{tag}>{text}{self.end(tag)}"

    def prose(self, a: int, b: int) -> str:
        text = " ".join(self.sentence() for _ in range(int(self.rng.integers(a, b + 1))))
        if self.often(0.15):
            text += f' <a href="/{self.word()}">{self.words(1, 4)}</a> {self.sentence()}'
        if self.often(0.15):
            text += " " + self.inline(self.words(1, 5)) + " " + self.sentence()
        elif self.often(0.1):
            text = self.inline(text)
        return text.replace(" ", "<br>", 1) if self.often(0.05) else text

    def p(self, text: str) -> str:
        return f"<p>{text}{self.end('p')}"

    def region(self, kind: str, mark: int, inner: str, inside: bool = False) -> str:
        """A marked element. What stands ``inside`` an article bears a name, or nobody could tell it apart."""
        name = self.one([x for x in NAMES[kind] if x or not inside])
        tag = self.one(TAGS[kind])
        needed = inside or kind in ("ad", "notice", "comments") and tag not in ("aside",)
        if self.plain and not needed and tag not in ("div", "section", "p", "ul", "ol"):
            name = ""
        elif self.plain and kind == "content":
            name = ""
        elif name and self.often(0.2):
            name += "-" + self.word()
        where = self.one(["class", "class", "id"])
        return f'<{tag} data-k="{mark}"' + (f' {where}="{name}"' if name else "") + f">{inner}</{tag}>"

    def links(self, a: int, b: int, sep: str = "") -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(int(self.rng.integers(a, b + 1)))]
        if self.often(0.6):
            return "<ul>" + "".join(f"<li>{x}{self.end('li')}" for x in items) + "</ul>"
        return (sep or self.one([" | ", " ", " &raquo; "])).join(items)

    def article(self) -> str:
        out = [f"<h1>{self.words(2, 9).capitalize()}{self.one(['', '.'])}</h1>"] if self.often(0.9) else []
        if out and self.often(0.15):
            out = [f"<header>{out[0]}</header>"]
        for _ in range(int(self.rng.choice([1, 2, 3, 5, 8, 12, 20]))):
            kind = self.rng.random()
            if kind < 0.78:
                out.append(self.p(self.prose(1, 7) if self.often(0.85) else self.words(1, 3).capitalize() + "."))
            elif kind < 0.85:
                level = self.one("234")
                out.append(f"<h{level}>{self.words(1, 7)}</h{level}>")
            elif kind < 0.90:
                tag = self.one(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.prose(1, 2)}{self.end('li')}" for _ in range(int(self.rng.integers(2, 7)))) + f"</{tag}>")
            elif kind < 0.93:
                out.append(f"<blockquote>{self.p(self.prose(1, 3))}</blockquote>")
            elif kind < 0.95:
                out.append(f"<div>{self.prose(1, 4)}</div>")
            elif kind < 0.97:
                out.append(f'<figure><img src="x.png"><figcaption>{self.sentence()}</figcaption></figure>')
            elif kind < 0.985:
                cell = self.one(["td", "td", "th"])
                rows = "".join(f"<tr><{cell}>{self.words(1, 3)}{self.end(cell)}<td>{self.words(1, 3)}{self.end('td')}{self.end('tr')}" for _ in range(int(self.rng.integers(2, 5))))
                out.append(f"<table>{rows}</table>")
            else:
                out.append(f"<pre>{self.words(5, 30)}</pre>")
            if self.often(0.08):
                out.append(self.other(self.one(["ad", "ad", "share", "side", "notice"]), inside=True))
        return "".join(out)

    def other(self, kind: str, inside: bool = False) -> str:
        if kind == "nav":
            inner = self.links(3, 12)
        elif kind == "header":
            inner = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(2, 8)}</p>" if self.often(0.4) else "") + (self.links(2, 6) if self.often(0.5) else "")
            inner = f"<h1>{inner}</h1>" if self.often(0.1) else inner
        elif kind == "footer":
            inner = f"&copy; {self.word()}.example.com &middot; {self.sentence(2, 10)}" if self.often(0.7) else f"<p>{self.prose(1, 3)}</p>"
            inner += self.links(2, 8) if self.often(0.4) else ""
        elif kind == "side":
            inner = (f"<h3>{self.words(1, 3)}</h3>" if self.often(0.6) else "") + (self.links(3, 8) if self.often(0.6) else "".join(f"<p>{self.prose(1, 2)}</p>" for _ in range(int(self.rng.integers(1, 4)))))
        elif kind == "comments":
            one = lambda: self.one(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", "<div><b>" + self.word() + "</b><p>{}</p></div>"]).format(self.prose(1, 4))
            inner = (f"<h2>{self.words(1, 3)}</h2>" if self.often(0.6) else "") + "".join(one() for _ in range(int(self.rng.integers(1, 8))))
        elif kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><p>{self.sentence(3, 10)}</p>'
        elif kind == "share":
            inner = self.links(2, 6, " ")
        else:
            inner = self.prose(1, 3) if self.often(0.6) else f"<p>{self.prose(1, 3)}</p>"
            inner += f' <a href="/x">{self.words(1, 3)}</a>' if self.often(0.3) else ""
        return self.region(kind, 0, inner, inside)


def framed(w: Writer) -> str:
    """A page whose frame is a table: rows for head and foot, cells for links and content."""
    bare = lambda inner, mark: f'<td data-k="{mark}"{w.one(["", "", " valign=top", " width=150", " colspan=2"])}>{inner}{w.end("td")}'
    row = lambda cells: f"<tr>{''.join(cells)}{w.end('tr')}"
    rows = [row([bare(w.one([w.links(3, 8), w.other("nav"), w.words(1, 4), w.other("header")]), 0)]) for _ in range(int(w.rng.integers(0, 3)))]
    cells = [bare(w.article(), 1)]
    for _ in range(int(w.rng.integers(0, 3))):
        cells.insert(int(w.rng.integers(0, 2)), bare(w.one([w.links(3, 12), w.other("side"), w.other("ad")]), 0))
    rows.append(row(cells))
    if w.often(0.3):
        rows.append(row([bare(w.other("comments"), 0)]))
    rows += [row([bare(w.one([f"&copy; {w.words(1, 4)}", w.other("footer"), f"<font size=1>{w.sentence(2, 8)} {w.links(1, 4)}</font>"]), 0)])] * w.often(0.8)
    return f'<table{w.one(["", " width=100%", " border=0"])}>{"".join(rows)}</table>'


def training_page(rng: np.random.Generator) -> str:
    """One page: regions before, around and after an article, flat, in wrappers or in a table."""
    w = Writer(rng)
    before = [w.other(k) for k in ("notice", "header", "nav", "nav", "ad", "form", "share") if w.often(0.4)]
    after = [w.other(k) for k in ("share", "ad", "side", "comments", "form", "notice", "nav") if w.often(0.4)] + [w.other("footer")] * w.often(0.85)
    rng.shuffle(before)
    beside = [w.other("side")] if w.often(0.3) else []
    if w.often(0.1):
        return f"<html><body>{framed(w)}</body></html>"
    middle = w.region("content", 1, w.article())
    if w.often(0.3):  # what belongs to the article's column but not to the article
        middle += "".join(w.other(k) for k in ("share", "comments", "comments", "side", "ad") if w.often(0.4))
        middle = f"<{(tag := w.one(['main', 'div', 'section']))}{w.one(['', ' id=' + w.word(), ' class=column'])}>{middle}</{tag}>"
    if w.often(0.4):
        middle = f'<div class="{w.one(["wrapper", "container", "row", "page", "layout", w.word()])}">{"".join([*beside, middle] if w.often(0.5) else [middle, *beside])}</div>'
    else:
        middle += "".join(beside)
    body = "".join(before) + middle + "".join(after)
    if w.often(0.2):
        body = f'<div id="{w.one(["page", "wrap", "root", w.word()])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{w.words(2, 8)}</title></head><body>{body}</body></html>"
