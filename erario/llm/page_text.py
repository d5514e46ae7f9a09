"""Main text of web pages by scoring the element tree.

A page becomes a tree of elements and the blocks of text they hold.  Each block gives its container one
point, one for every comma, and one for every hundred characters; a container hands half its points on
to the container around it, and its share of text outside links scales what it has.  The container with
most points is the article; siblings that score a fifth of it, and plain paragraphs beside it, belong
to it.  If the container lies in an ``article`` element, that element is taken instead.

Left out wherever they stand: elements that never hold the article (``DROPPED``), hidden ones, those
whose role, class or id names them a menu, notice, advert, comment section and so on (``NAMES``), and
lists of links.  An element with an ``h1``, ``article`` or ``main`` inside is not judged by its name.
Of a ``header`` inside an article the headings stay.

Results by case: null, empty or text-free pages give an empty text.  Pages of any length and nesting are
read whole, in time that grows with their length; unclosed elements end where the next one of their kind
or the page ends; of an unclosed script, style or comment the rest of the page is part.  Repeated rows give
a row each, null ids and urls stay null, other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: names of HTML elements, and of the parts of a page ---------
#: Elements that hold no tags, up to their end tag.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text is a block of its own.
BLOCKS = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "th", "center", "details"}
DROPPED = RAW | {
    "head", "nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "template", "dialog", "menu", "search",
    "object", "audio", "video", "datalist", "fieldset",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu",
    "menubar", "toolbar", "form",
}
COMMENTS = {"comment", "comments", "disqus", "respond", "replies", "commentlist"}
NAMES = COMMENTS | {
    "nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "ad", "ads", "advert",
    "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies",
    "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "toolbar", "skip", "copyright",
}
#: A first word that says a name is of something else: "no-sidebar".
UNLESS = {"no", "has", "with", "without", "is"}
#: A start tag ends an open element of the first kinds, unless one of the second was opened after it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Only the end tags of tables end a cell that was opened later.
CELLS, TABLE = {"td", "th", "caption"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
COMMA = re.compile("[,،、，]")
STOP = re.compile(r"[.!?…。！？]")

#: A sibling belongs to the article from this share of its points; a list is a menu from this share of links.
SIBLING_SHARE, MENU_SHARE, MENU_LINKS = 0.2, 0.8, 3


class Element:
    """A node: its place in page order, the one around it, and what its attributes say."""

    __slots__ = (
        "tag", "parent", "end", "named", "comment", "hidden", "held", "link", "lost", "muted",
        "points", "chars", "linked", "links", "stops")

    def __init__(self, tag: str, parent: int, number: int, attributes: str = ""):
        self.tag, self.parent, self.end = tag, parent, number + 1
        self.named = self.comment = self.hidden = self.held = self.link = self.lost = self.muted = self.stops = False
        self.points = 0.0
        self.chars = self.linked = self.links = 0
        for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
            self._judge(name.lower(), value.strip("\"'"))

    def _judge(self, name: str, value: str) -> None:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            self.hidden = True
        elif name == "style":
            self.hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "role":
            self.named |= value.lower() in ROLES
        elif name in ("class", "id"):
            for token in unescape(value).split():
                words = [w.lower() for w in WORDS.findall(token)]
                if words and words[0] not in UNLESS and not NAMES.isdisjoint(words):
                    self.named = True
                    self.comment |= not COMMENTS.isdisjoint(words)


class Tree:
    """Elements in page order, and texts with the number of their element; None ends a block."""

    def __init__(self, html: str):
        self.elements, self.texts = [Element("html", -1, 0)], []
        #: Numbers of the open elements; their places in this stack by tag, and of all blocks among them.
        self.stack, self.depths, self.open_blocks = [0], {"html": [0]}, [0]
        position, size = 0, len(html)
        while position < size:
            found = TOKEN.search(html, position)
            if (upto := found.start() if found else size) > position:
                self.texts.append((self.stack[-1], html[position:upto]))
            position = found.end() if found else size
            if found and (tag := found[2]):
                tag = tag.lower()
                if found[1]:
                    self._end(tag)
                else:
                    self._start(tag, found[3])
                    if tag in RAW:
                        last = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, position)
                        position = last.end() if last else size
        self._close(0)

    def _last(self, tags) -> int:
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=-1)

    def _close(self, depth: int) -> None:
        """End the open elements from this depth of the stack on."""
        for number in reversed(self.stack[depth:]):
            e = self.elements[number]
            e.end = len(self.elements)
            self.depths[e.tag].pop()
            if e.tag in BLOCKS:
                self.open_blocks.pop()
                self.texts.append((number, None))
        del self.stack[depth:]

    def _end(self, tag: str) -> None:
        depth = self._last((tag,))
        if depth <= 0 or tag not in TABLE and self._last(CELLS) > depth:
            return
        if tag in BLOCKS or tag == "a" or self.open_blocks[-1] < depth:
            self._close(depth)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "html" or tag == "body" and self.depths.get(tag):
            return
        for ended, bound in (({"p"}, CELLS) if tag in BLOCKS else ((), ()), ENDS.get(tag, ((), ()))):
            if (depth := self._last(ended)) > self._last(bound):
                self._close(depth)
        number, up = len(self.elements), self.stack[-1]
        e = Element(tag, up, number, attributes)
        e.link = tag == "a" or self.elements[up].link
        self.elements.append(e)
        if tag in BLOCKS:
            self.texts.append((number, None))
        elif tag == "br":
            self.texts.append((up, " "))
        if tag not in VOID and tag not in RAW:
            self.depths.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCKS:
                self.open_blocks.append(len(self.stack))
            self.stack.append(number)


def mark_lost(elements: list[Element], by_name: bool) -> None:
    """Mark what cannot belong to the article, and all inside it."""
    for e in reversed(elements):
        if e.parent >= 0 and (e.held or e.tag in ("h1", "article", "main")):
            elements[e.parent].held = True
    inside_article = [False] * len(elements)
    for number, e in enumerate(elements):
        up = elements[max(e.parent, 0)]
        inside_article[number] = e.tag == "article" or inside_article[max(e.parent, 0)]
        e.lost = e.hidden or e.tag in DROPPED or e.tag == "header" and not inside_article[number] or number > 0 and up.lost
        e.muted = e.tag not in HEADINGS and (e.tag == "header" or up.muted)  # of a header, headings stay
        if by_name and e.named and e.tag not in ("html", "body", "main", "h1"):
            e.lost |= e.comment or not (e.held or e.tag == "article")


def blocks(elements: list[Element], texts: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """The blocks in page order: block element, text, and characters inside links."""
    owner = [0] * len(elements)
    for number, e in enumerate(elements):
        owner[number] = number if e.tag in BLOCKS else owner[max(e.parent, 0)]
    found, parts, block, linked = [], [], -1, 0
    for number, text in [*texts, (0, None)]:
        if text is None or owner[number] != block:
            if parts and (whole := SPACE.sub(" ", "".join(parts)).strip()):
                found.append((block, whole, linked))
            parts, linked, block = [], 0, owner[number]
        if text is not None and not elements[number].lost and not elements[number].muted:
            parts.append(unescape(text))
            linked += len(text.strip()) if elements[number].link else 0
    return found


def score(elements: list[Element], found: list[tuple[int, str, int]]) -> None:
    """Points of the containers, and characters in and outside links of every element."""
    for number, text, linked in found:
        e = elements[number]
        e.chars += len(text)
        e.linked += min(linked, len(text))
        e.stops |= bool(STOP.search(text))
        e.points += 1 + len(COMMA.findall(text)) + len(text) / 100
    for e in reversed(elements):
        if e.tag == "a" and not e.lost:
            e.links += 1
        if e.parent >= 0:
            up = elements[e.parent]
            up.chars, up.linked, up.links = up.chars + e.chars, up.linked + e.linked, up.links + e.links
            up.points += e.points / 2 if e.tag in CONTAINERS else e.points


def _density(e: Element) -> float:
    return e.linked / e.chars if e.chars else 1.0


def _worth(e: Element) -> float:
    return e.points * (1 - _density(e))


def _belongs(e: Element, best: Element) -> bool:
    """Whether a sibling of the best container belongs to the article too."""
    if e.lost or best.tag == "article" and e.tag != "article":
        return False
    if e.tag in CONTAINERS:
        return _worth(e) >= SIBLING_SHARE * _worth(best) and _density(e) < 0.5
    long_enough = e.chars > 80 and _density(e) < 0.25 or e.stops and e.linked == 0
    return e.tag == "h1" or e.tag in ("p", "pre", "blockquote") and long_enough


def _siblings(elements: list[Element], best: int) -> list[int]:
    up, kept = elements[best].parent, []
    number = up + 1
    while up >= 0 and number < elements[up].end:
        if number != best and _belongs(elements[number], elements[best]):
            kept.append(number)
        number = elements[number].end
    return kept


def _menus(elements: list[Element]) -> list[tuple[int, int]]:
    """Lists made of links, as ranges of elements."""
    return [
        (number, e.end) for number, e in enumerate(elements)
        if e.tag in ("ul", "ol") and e.links >= MENU_LINKS and e.linked >= MENU_SHARE * e.chars
    ]


def main_text(html: str | None) -> str:
    """The article of a page, a line a block; empty if there is none."""
    if not html:
        return ""
    tree = Tree(html)
    elements = tree.elements
    mark_lost(elements, by_name=True)
    if not (found := blocks(elements, tree.texts)):
        mark_lost(elements, by_name=False)  # its whole text lies under a name of NAMES
        if not (found := blocks(elements, tree.texts)):
            return ""
    score(elements, found)
    best = max(
        (n for n, e in enumerate(elements) if e.tag in CONTAINERS and not e.lost),
        key=lambda n: (_worth(elements[n]), n), default=0)
    if _worth(elements[best]) <= 0:
        return ""
    at = best
    while at >= 0 and elements[at].tag != "article":
        at = elements[at].parent
    if at >= 0:
        best = at
    roots = sorted((n, elements[n].end) for n in [best, *_siblings(elements, best)])
    menus = _menus(elements)
    lines, r, m = [], 0, 0
    ordered = sorted(range(len(found)), key=lambda i: found[i][0])
    inside = [False] * len(found)
    for i in ordered:  # both kinds of ranges lie apart or one in the other, in page order
        number = found[i][0]
        while r < len(roots) and roots[r][1] <= number:
            r += 1
        while m < len(menus) and menus[m][1] <= number:
            m += 1
        inside[i] = r < len(roots) and roots[r][0] <= number and not (m < len(menus) and menus[m][0] <= number)
    for keep, (_, text, _) in zip(inside, found, strict=True):
        if keep:
            lines.append(text)
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text) of every page."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in html.tolist()], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text"))
