"""Blocks and node features of HTML pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np

# Element names of the HTML standard by role.
BLOCKS = (
    "html body article aside blockquote center address dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul").split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style template iframe svg textarea select datalist button title head".split())
RAW = set("script style textarea title".split())  # an open one takes the rest of the page
CLOSES_P = set(BLOCKS) - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# Words of class, id and role attributes by what they usually mark.
ATTRIBUTE_WORDS = {
    "content": "article content contents post entry story body text main blog news hentry prose reading paragraph articlebody postbody",
    "nav": "nav menu navbar navigation navi breadcrumb breadcrumbs toc tabs tab pagination pager topbar sitemap menubar links",
    "head": "header head masthead logo branding top hero topbar siteheader",
    "foot": "footer foot copyright colophon bottom legal imprint contentinfo sitefooter",
    "side": "sidebar side aside widget widgets related rail recommended recommend trending popular more secondary complementary teaser teasers",
    "ad": "ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor sponsored banner commercial dfp adslot adbox",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe paywall toast privacy warning message notification announcement",
    "comment": "comment comments reply replies disqus discussion respond feedback responses reader commentlist thread",
    "form": "form login search signup register input contact signin subscribe",
    "share": "share sharing social follow tools toolbar buttons tags meta byline",
}
CATEGORY = {word: i for i, words in enumerate(ATTRIBUTE_WORDS.values()) for word in words.split()}
N_CATEGORIES = len(ATTRIBUTE_WORDS)
TAG_GROUPS = [
    {"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend", "search", "dialog"}, {"section"}, {"div", "center"},
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "dir"}, {"li", "dt", "dd"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"figure", "figcaption", "blockquote", "pre"}, {"html", "body"}]
TAG_GROUP = {tag: i for i, tags in enumerate(TAG_GROUPS) for tag in tags}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|data-k)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Block elements in page order (parents first) and the text blocks that they own."""

    __slots__ = ("tag", "parent", "depth", "end", "flags", "mark", "chars", "link", "words", "punctuation", "inline", "blocks")

    def __init__(self, text: str, marked: bool = False):
        """``marked`` reads the marks of generated pages; on other pages such attributes mean nothing."""
        for name in self.__slots__:
            setattr(self, name, [])
        self._read(text, marked)

    def _open(self, tag: str, raw: str, parent: int, marked: bool) -> int:
        flags, mark = 0, -1
        if raw and "=" in raw:
            for m in ATTRIBUTE.finditer(raw):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "data-k":
                    mark = int(value) if marked else -1
                    continue
                for word in PART.findall(value):
                    c = CATEGORY.get(word.lower())
                    if c is not None:
                        flags |= 1 << c
        at = len(self.tag)
        self.tag.append(TAG_GROUP.get(tag, len(TAG_GROUPS)))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.flags.append(flags)
        self.mark.append(mark)
        for column in (self.end, self.chars, self.link, self.words, self.punctuation, self.inline):
            column.append(0)
        return at

    def _read(self, text: str, marked: bool) -> None:
        stack: list[tuple[str, int]] = [("", self._open("html", "", -1, marked))]  # names and nodes of open blocks
        opened: Counter[str] = Counter()  # names in the stack
        unclosed: set[str] = set()  # skipped elements that no later end tag closes
        block: list[str] = []
        links, link_from = 0, -1
        size = link_size = tags = 0

        def flush() -> None:
            nonlocal size, link_size, tags, link_from
            if block:
                words = "".join(block).split()
                if words:
                    joined, node = " ".join(words), stack[-1][1]
                    self.blocks.append((node, joined))
                    self.chars[node] += len(joined)
                    self.link[node] += min(link_size, len(joined))
                    self.words[node] += len(words)
                    self.punctuation[node] += len(PUNCTUATION.findall(joined))
                    self.inline[node] += tags
                block.clear()
            size = link_size = tags = 0

        def close(depth: int) -> None:
            flush()
            while len(stack) > depth:
                name, node = stack.pop()
                opened[name] -= 1
                self.end[node] = len(self.tag)

        def add(piece: str) -> None:
            nonlocal link_size
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                block.append(piece)
                if links:
                    link_size += len(piece.strip())

        at = 0
        while True:
            m = TOKEN.search(text, at)
            if m is None:
                add(text[at:])
                break
            add(text[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, raw = name.lower(), m[1] or m[4], m[3] or m[6]
            if name in SKIPPED:
                if not closing and not (raw or "").endswith("/"):
                    stop = None if name in unclosed else _end_of(name, text, at)
                    if stop is None:
                        unclosed.add(name)
                    at = stop or (len(text) if name in RAW else at)
                continue
            if name == "br":
                block.append(" ")
            elif name == "a":
                links = 0 if closing else 1
                tags += not closing
            elif name not in TAG_GROUP and name != "hr":
                tags += not closing
            elif closing:
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name) if opened[name] else 0
                if depth:
                    close(depth)
                else:
                    flush()
            elif name in ("html", "body") and len(stack) > 1:
                flush()
            else:
                if name in CLOSES_P and stack[-1][0] == "p":
                    close(len(stack) - 1)
                for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in CLOSES.get(name, ())) else ():
                    if stack[i][0] in SCOPE.get(name, ()):
                        break
                    if stack[i][0] in CLOSES.get(name, ()):
                        close(i)
                        break
                flush()
                if name not in VOID:
                    links = 0
                    stack.append((name, self._open(name, raw, stack[-1][1], marked)))
                    opened[name] += 1
        close(0)


@lru_cache(maxsize=32)
def _edges(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


def _end_of(name: str, text: str, at: int) -> int | None:
    """Where the skipped element that opened before ``at`` ends; elements of its own kind nest, but for raw text and head."""
    depth = 1
    for m in _edges(name).finditer(text, at):
        if m[1]:
            depth -= 1
        elif name not in RAW and name != "head" and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return None


def features(pages: list[Page]) -> np.ndarray:
    """One row of features for every node of the pages, in order."""
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = int(sizes.sum())
    column = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    tag, depth, flags = column("tag"), column("depth"), column("flags")
    parent = column("parent")
    root = parent < 0
    parent = np.where(root, np.arange(total), parent + base)
    end = column("end") + base
    own = np.stack([column(n) for n in ("chars", "link", "words", "punctuation", "inline")], 1).astype(np.float64)
    ones = np.ones((total, 1))
    group = np.zeros((total, len(TAG_GROUPS) + 1))
    group[np.arange(total), tag] = 1
    counted = np.concatenate([own, ones, group[:, 8:9], group[:, 9:10], group[:, 11:12]], 1)
    upto = np.concatenate([np.zeros((1, counted.shape[1])), np.cumsum(counted, 0)])
    at = np.arange(total)
    below = upto[end] - upto[at]
    page = np.repeat(np.arange(len(pages)), sizes)
    first = (np.cumsum(sizes) - sizes)[page]
    whole = below[first]
    before = upto[at] - upto[first]
    kin_n = np.bincount(parent[~root], minlength=total).astype(float)
    kin_chars = np.bincount(parent[~root], below[~root, 0], minlength=total)
    kin_links = np.bincount(parent[~root], below[~root, 1], minlength=total)
    bits = (flags[:, None] >> np.arange(N_CATEGORIES)) & 1
    # What an ancestor's tag or attributes say, the parent's included: each round looks twice as far up.
    says = np.concatenate([bits, group[:, :6]], 1)
    above, up = np.where(root[:, None], 0, says[parent]), parent
    for _ in range(int(depth.max(initial=0)).bit_length()):
        above, up = np.maximum(above, above[up]), up[up]
    rate = lambda a, b: a / np.maximum(b, 1)
    chars, link, words, punctuation, inline, nodes, paragraphs, heads, items = below.T
    return np.column_stack([
        group[:, :-1], bits, above, np.where(root[:, None], 0, group[parent]), np.where(root[:, None], 0, bits[parent]), np.minimum(depth, 20), np.log1p(chars), rate(link, chars), np.log1p(words), rate(chars, words), rate(punctuation, words),
        rate(inline, words), np.log1p(nodes), rate(chars, nodes), np.log1p(own[:, 0]), rate(own[:, 1], own[:, 0]), np.log1p(paragraphs), np.log1p(heads), np.log1p(items),
        rate(chars, whole[:, 0]), rate(before[:, 0], whole[:, 0]), rate(at - first, sizes[page]), np.minimum(kin_n[parent], 50), rate(kin_chars[parent], kin_n[parent]) - chars > 0,
        np.log1p(rate(kin_chars[parent], kin_n[parent])), rate(kin_links[parent], kin_chars[parent]), rate(chars, kin_chars[parent]), np.log1p(whole[:, 0]),
    ]).astype(np.float64)
