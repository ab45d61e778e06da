"""Main-text extraction from raw HTML by text-to-tag ratios.

Standard-library parser events are turned into lines (one per block). Each line has a
text-to-tag ratio; the ratios, on a log scale, are smoothed with a Gaussian and split by
two-means clustering. The lines of the high cluster say which element holds the article: the
innermost article or main element with most of their text or, if none has it, the innermost block that can hold paragraphs;
all its blocks count, short ones too, except blocks that elements, class names or attributes mark
as menus, headers, footers, sidebars, notices, adverts, forms, reader comments or hidden. Where no
article or main element holds the text, blocks before and after it that are mostly links go too.

A mark is judged by the cluster, not the other way round: an element that is marked but holds most of the
high cluster's text, and an article in it or several of its lines, wraps the article and is no region
beside it; nor is a marked part of an article that holds much of that text in several lines, unless it is marked as
comments. Class names count whole: each word of ``cookie-notice`` is a mark or a filler, but ``has-sidebar``,
``no-comments`` and ``social-policy`` mark nothing; names on paragraphs, headings and the like are style.

Defined cases: null or empty HTML gives an empty text; a null page_id or url stays null; a page cut
off in the middle gives what came before the cut; unclosed elements end where their parents end;
very long and very deep pages are read whole, in time proportional to their length; repeated rows
are read one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NOT_TEXT = frozenset("head script style noscript template iframe svg object canvas audio video math".split())
NOT_ARTICLE = frozenset("nav aside footer form menu dialog button select textarea".split())
PARTS = frozenset("article main".split())
HOLDERS = frozenset("article body div main section table tbody td".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments respond replies disqus cookie cookies consent notice notices alert newsletter subscribe subscription popup modal overlay breadcrumb breadcrumbs menu nav navbar navigation footer share sharing social related recommended widget pagination pager login signup".split())
COMMENTS = frozenset("comment comments respond replies disqus".split())
#: Words that may stand beside a mark in a name.
FILLERS = frozenset("area articles bar block blocks bottom box button buttons center column container content feed floating footer form global group header holder icons inline inner items left link links list main message outer page panel popular post posts primary promo region right row secondary section site slot small sticky stories text thread top unit wrap wrapper".split())
#: Elements whose class names tell a style, not a region.
STYLED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption td th dd dt li a b i em strong span code".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SIGMA = 1.0
#: Share of the high cluster's text that the chosen element must hold.
HOLDS = 0.7

#: How an element is marked: by a class name, as comments, by what it is, as hidden.
_NAMED, _COMMENTS, _ELEMENT, _HIDDEN = 1, 2, 3, 4

_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-2, 3)]
_NAMES = re.compile(r"[^a-z0-9]+")
#: What a tag begins with, or a page that ends in the middle of one.
_TAG = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _named(value: str, inside: bool) -> int:
    """How a class or id marks an element: by a name made of marks and fillers."""
    found = 0
    for name in value.lower().split():
        words = [w for w in _NAMES.split(name) if w and not w.isdigit()]
        marks = [w for w in words if w in MARKS or not inside and w == "header"]
        if marks and all(w in MARKS or w in FILLERS for w in words):
            found = max(found, _COMMENTS if any(w in COMMENTS for w in marks) else _NAMED)
    return found


def _mark(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    found = _ELEMENT if tag in NOT_ARTICLE or tag == "header" and not inside else 0
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _UNSEEN.search(v.lower()):
            return _HIDDEN
        if v and tag not in ("html", "body", "article", "main"):
            if k == "role" and v.lower() in ROLES:
                found = _ELEMENT
            elif k in ("class", "id") and tag not in STYLED:
                found = max(found, _named(v, inside))
    return found


class _Blocks(HTMLParser):
    """Collects lines: (text, tags, code points of links, element number), and how elements are marked.

    Elements are numbered as they open; ``last[n]`` is the largest number inside element n, so a
    line is inside n if its own element's number lies from n to last[n]. How many elements of a
    name are open is counted, so that end tags without a start cost nothing, however deep the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.stack: list[tuple[str, bool, int]] = []  # element, inside the article, number
        self.open: Counter[str] = Counter()
        self.names: list[str] = []
        self.parent: list[int] = []
        self.marks: list[int] = []
        self.last: list[int] = []
        self.text: list[str] = []
        self.tags = self.linked = self.silent = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1][2] if self.stack else -1))
            self.text = []
            self.tags = self.linked = 0

    def pop_to(self, depth: int) -> None:
        for tag, _, n in self.stack[depth:]:
            self.silent -= tag in NOT_TEXT
            self.open[tag] -= 1
            self.last[n] = len(self.names) - 1
        del self.stack[depth:]

    def close_open(self, tag: str, stop: frozenset[str]) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if self.stack[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK or tag == "br":
            if tag != "br":
                self.flush()
                self.close_open("p", BLOCK - {"p"})
            else:
                self.text.append(" ")
            if tag == "li":
                self.close_open("li", frozenset(("ul", "ol", "menu")))
            elif tag in PARTS:
                self.close_open("nav", frozenset(("aside", "body")))
        if tag in VOID:
            return
        if tag == "body":
            self.close_open("head", frozenset())
        _, inside, parent = self.stack[-1] if self.stack else ("", False, -1)
        self.silent += tag in NOT_TEXT
        self.open[tag] += 1
        self.stack.append((tag, inside or tag in PARTS, len(self.names)))
        self.names.append(tag)
        self.marks.append(_mark(tag, attrs, inside))
        self.parent.append(parent)
        self.last.append(-1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            self.close_open(tag, frozenset())

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data)


def two_means(values: list[float]) -> float:
    """The threshold between two clusters of numbers; below all numbers if they are one cluster."""
    lo, hi = min(values), max(values)
    if hi - lo < 1e-9:
        return lo - 1
    while True:
        cut = (lo + hi) / 2
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        a, b = sum(low) / len(low), sum(high) / len(high)
        if abs(a - lo) + abs(b - hi) < 1e-9:
            return cut
        lo, hi = a, b


def smoothed(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for k in range(max(0, i - 2), min(n, i + 3)):
            w = _KERNEL[k - i + 2]
            total += w * values[k]
            weight += w
        out.append(total / weight)
    return out


def _uncut(html: str) -> str:
    """A page without the tag that its end cuts off, however long that tag is."""
    at = html.find("<", html.rfind(">") + 1)
    return html[:at] if at >= 0 and _TAG.match(html, at) else html


def _ratio(line: tuple[str, int, int, int]) -> float:
    return math.log1p(len(line[0]) / max(1, line[1]))


def _mass(parser: _Blocks, content: list[int], weigh=len) -> list[int]:
    """The text (or what else is weighed) of these lines inside each element."""
    mass = [0] * len(parser.names)
    for i in content:
        if parser.lines[i][3] >= 0:
            mass[parser.lines[i][3]] += weigh(parser.lines[i][0])
    for n in range(len(mass) - 1, -1, -1):  # an element's text counts for its parent, which has a smaller number
        if parser.parent[n] >= 0:
            mass[parser.parent[n]] += mass[n]
    return mass


def _left_out(parser: _Blocks) -> list[bool]:
    """Which lines are in marked elements, where the cluster over all lines doesn't speak for the mark."""
    marks, parent, names, lines = parser.marks, parser.parent, parser.names, parser.lines
    n = len(names)
    if any(0 < m < _HIDDEN for m in marks):
        shown = [False] * n
        for k in range(n):
            shown[k] = marks[k] != _HIDDEN and (parent[k] < 0 or shown[parent[k]])
        ratio = smoothed([_ratio(x) if x[3] < 0 or shown[x[3]] else 0.0 for x in lines])
        threshold = two_means(ratio)
        content = [i for i, x in enumerate(lines) if ratio[i] > threshold and (x[3] < 0 or shown[x[3]])]
        mass, rows = _mass(parser, content), _mass(parser, content, lambda _: 1)
        total = sum(len(lines[i][0]) for i in content)
        parts = [0] * n  # articles inside, itself not counted
        part, plain = [False] * n, False  # inside an article; is there one outside all marks?
        marked = [False] * n
        for k in range(n):
            up = parent[k]
            marked[k] = marks[k] > 0 or up >= 0 and marked[up]
            part[k] = up >= 0 and (part[up] or names[up] in PARTS)
            plain = plain or names[k] in PARTS and not marked[k] and mass[k] > 0
        for k in range(n - 1, -1, -1):
            if parent[k] >= 0:
                parts[parent[k]] += parts[k] + (names[k] in PARTS and mass[k] > 0)
        for k in range(n):
            wraps = mass[k] >= HOLDS * total and (parts[k] or not plain and rows[k] > 2)
            if total and marks[k] < _HIDDEN and (wraps or marks[k] == _NAMED and part[k] and rows[k] > 2 and mass[k] >= (1 - HOLDS) * total):
                marks[k] = 0
    gone = [False] * n
    for k in range(n):
        gone[k] = marks[k] > 0 or parent[k] >= 0 and gone[parent[k]]
    return [x[3] >= 0 and gone[x[3]] for x in lines]


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(_uncut(html))
    parser.close()
    parser.flush()
    parser.pop_to(0)
    lines = parser.lines
    if not lines:
        return ""
    out = _left_out(parser)
    ratio = smoothed([0.0 if gone else _ratio(line) for line, gone in zip(lines, out, strict=True)])
    threshold = two_means(ratio)
    usable = [i for i in range(len(lines)) if not out[i]]
    if not usable:
        return ""
    content = [i for i in usable if ratio[i] > threshold] or usable
    mass = _mass(parser, content)
    total = sum(len(lines[i][0]) for i in content)
    holds = [n for n, m in enumerate(mass) if m >= HOLDS * total]
    chosen = max((n for n in holds if parser.names[n] in PARTS), default=-1)  # numbers grow inwards: the innermost
    article = chosen >= 0
    if not article:
        chosen = max((n for n in holds if parser.names[n] in HOLDERS), default=-1)
    inside = [i for i in usable if chosen < 0 or chosen <= lines[i][3] <= parser.last[chosen]]
    if article:
        return " ".join(lines[i][0] for i in inside)
    # without an article element, blocks before and after the content count unless they are links
    first, last = min(content), max(content)
    return " ".join(lines[i][0] for i in inside if first <= i <= last or 2 * lines[i][2] < len(lines[i][0]))


def _pages(batches):
    for pdf in batches:
        text = [extract(h if isinstance(h, str) else None) for h in pdf.html]
        yield pd.DataFrame({"page_id": pdf.page_id.astype("Int64"), "url": pdf.url, "text": text, "n_chars": [len(t) for t in text]})


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(_pages, "page_id long, url string, text string, n_chars long")
