"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one a block element, in one pass over the page. A line weighs its
characters, those in links against it; names of page furniture and the elements ``article`` and
``main`` lower or raise the weight. Weights are summed over sliding windows of lines. Text starts
where the sums surge above a threshold, which follows from the page's own sums, and ends where they
dive to nothing; of the ranges found, those far lighter than the heaviest go. What lies in the others is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names, and the words of class, id and role that tell of page furniture.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("head nav footer aside script style noscript template svg canvas object iframe select button dialog menu noembed noframes textarea title xmp".split())
NEVER_BY_NAME = {"html", "body", "main"}
#: How much more a line of a trusted scope weighs.
SCOPE_WEIGHT = 12.0
#: One of these among the parts of a name is enough.
TELLING = set("advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal navbar menubar breadcrumb breadcrumbs pagination pager masthead colophon sidebar disqus commentlist newsletter signup login toolbar comments taboola outbrain recirc trending donate sharebar".split())
#: These tell only if most parts of the name, but for words of layout, are such.
FURNITURE = TELLING | set("ad ads adv promo promotion banner notice notices alert overlay nav navigation menu header footer copyright aside rail widget widgets related recommended recommendations comment comments reply replies respond responses discussion share sharing social subscribe subscription search skip tags form".split())
READERS = set("disqus commentlist comment comments reply replies respond responses discussion".split())
LAYOUT = set("a area article bar block blog body bottom box col column container content entry fb first global google group id info inner is item items js last layout left link links list main meta module new old outer page panel post primary reader readers right row secondary section site slot text title to top trail unit user visitor visitors wp wrap wrapper thread threads stories posts buttons button cta sticky gallery legal most".split())
#: Lists of what others read.
POPULAR = re.compile(r"most[-_]?(?:read|viewed|popular|shared)", re.I)
NEGATING = {"has", "with", "no", "without", "hide", "show"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = {"li", "td", "th", "tr", "dt", "dd"}
LEGAL = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)


class _Line:
    __slots__ = ("parts", "links", "mark", "scope", "gap", "doubt")

    def __init__(self, mark: int, scope: int, gap: int, doubt: bool):
        self.parts, self.links, self.mark, self.scope, self.gap, self.doubt = [], 0, mark, scope, gap, doubt


def name_share(names: str) -> tuple[float, bool]:
    """Which share of the telling parts of class and id names are words of furniture, and whether readers write there."""
    good = bad = 0
    readers = False
    for name in names.split():
        bad += 1000 if POPULAR.search(name) else 0
        negated = False
        for part in NAME_PARTS.findall(name):
            word = part.lower()
            if word in NEGATING:
                negated = True
            elif word in FURNITURE and not negated:
                bad += 1000 if word in TELLING else 1
                readers |= word in READERS
            elif word not in LAYOUT and word not in FURNITURE:
                good += 1
    return (bad / (bad + good) if bad else 0.0), readers


def _say(tag: str, attrs: str, in_article: bool) -> str | None:
    """'hard': no text of an article; 'layout' or 'readers': the names say so; 'doubt': half of them do."""
    if tag in DROPPED:
        return "hard"
    if tag == "header":
        return "header" if in_article else "hard"
    if tag == "form":
        return "layout"
    if tag in NEVER_BY_NAME or not attrs or attrs.isspace():
        return None
    values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return "hard"
    if values.get("role", "").lower() in ROLES:
        return "layout"
    share, readers = name_share(values.get("class", "") + " " + values.get("id", ""))
    if share > 0.5:
        return "readers" if readers else "layout"
    return "doubt" if share else None


class _Page:
    """The lines of a page, its marks as chains (each with the one around it) and its scopes (article, main)."""

    def __init__(self, html: str):
        self.lines: list[_Line] = []
        self.around, self.kind, self.cleared = [0], ["none"], [True]  # mark 0: none
        self.titled: set[int] = set()  # scopes with a main heading
        self._stack: list[tuple[str, str | None]] = []
        self._blocks: list[int] = []  # where the blocks are in the stack
        self._inline: list[dict[str, int]] = [{}]  # open inline elements within each of them
        self._open: dict[str, int] = {}
        self._mark, self._scope, self._scopes, self._in_scope = 0, 0, 0, 0
        self._hard = self._head = self._heading = self._links = self._doubt = 0
        self._gap, self._breaks, self._new = 0, 0, True
        self._scan(html)

    def _text(self, s: str) -> None:
        if not s or self._hard or (self._head and not self._heading):
            return
        blank = s.isspace()
        if self._new:
            if blank:
                return
            self.lines.append(_Line(self._mark, self._scope, self._gap, self._doubt > 0))
            self._new, self._gap = False, 0
        line = self.lines[-1]
        line.parts.append(s)
        if not blank:
            self._breaks = 0
        if self._links:
            line.links += len(s.strip())

    def _push(self, tag: str, attrs: str) -> None:
        say = _say(tag, attrs, self._in_scope > 0)
        if tag in ("main", "h1"):
            n = self._mark
            while not self.cleared[n]:  # what holds the title or the main part is no furniture
                self.cleared[n] = True
                n = self.around[n]
            if tag == "h1" and self._scope:
                self.titled.add(self._scope)
        self._stack.append((tag, say))
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag in BLOCK:
            self._blocks.append(len(self._stack) - 1)
            self._inline.append({})
        else:
            self._inline[-1][tag] = self._inline[-1].get(tag, 0) + 1
        if say in ("layout", "readers"):
            self.around.append(self._mark)
            self.kind.append(say)
            self.cleared.append(False)
            self._mark = len(self.around) - 1
        elif tag in ("article", "main"):
            self._in_scope += 1
            if self._in_scope == 1:  # the outermost one counts
                self._scopes += 1
                self._scope = self._scopes
        self._hard += say == "hard"
        self._head += say == "header"
        self._doubt += say == "doubt"
        self._heading += tag in HEADINGS
        self._links += tag == "a"

    def _pop(self, to: int) -> None:
        for _ in range(len(self._stack) - to):
            tag, say = self._stack.pop()
            self._open[tag] -= 1
            if tag in BLOCK:
                self._blocks.pop()
                self._inline.pop()
            else:
                self._inline[-1][tag] -= 1
            if say in ("layout", "readers"):
                self._mark = self.around[self._mark]
            elif tag in ("article", "main"):
                self._in_scope -= 1
                if not self._in_scope:
                    self._scope = 0
            self._hard -= say == "hard"
            self._head -= say == "header"
            self._doubt -= say == "doubt"
            self._heading -= tag in HEADINGS
            self._links -= tag == "a"

    def _close(self, tag: str) -> None:
        if not self._open.get(tag) or (tag not in BLOCK and not self._inline[-1].get(tag)):
            return  # not open; and an inline end tag does not close a block
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                self._pop(i)
                return

    def _scan(self, html: str) -> None:
        at, size, quotes, data = 0, len(html), True, True
        while at < size:
            start = html.find("<", at)
            if start < 0:
                start = size
            if start > at:
                piece = html[at:start]
                self._text(unescape(piece) if "&" in piece else piece)
                at = start
                continue
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = end + 3 if end >= 0 else size
                continue
            if data and html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                data = end >= 0
                if data:
                    self._text(html[at + 9 : end])
                    at = end + 3
                    continue
            m = TAG.match(html, at)
            if not m:
                if html[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < size:
                    end = html.find(">", at)
                    at = end + 1 if end >= 0 else size
                else:
                    self._text("<")
                    at += 1
                continue
            end, quotes = self._tag_end(html, m.end(), quotes)
            if end < 0:
                return  # an element that never ends
            closes, tag, attrs, at = m[1], m[2].lower(), html[m.end() : end], end + 1
            at = self._element(html, closes, tag, attrs, at)
        self._pop(0)

    @staticmethod
    def _tag_end(html: str, at: int, quotes: bool) -> tuple[int, bool]:
        """Where a tag ends; once quotes were met that never lead to an end, they mean nothing in the rest of the page."""
        i = at
        while quotes:
            m = STOP.search(html, i)
            if m and m[0] == ">":
                return m.start(), True
            i = html.find(m[0], m.end()) + 1 if m else 0
            if not i:
                quotes = False
        return html.find(">", at), False

    def _element(self, html: str, closes: str, tag: str, attrs: str, at: int) -> int:
        if tag == "br":
            self._breaks += 1
            if self._breaks > 1:
                self._new = True
            elif not self._new:
                self._text(" ")
            return at
        if tag in BLOCK:
            self._new, self._gap, self._breaks = True, self._gap + 1, 0
        if closes:
            self._close(tag)
            return at
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            return at
        if tag == "body":
            self._pop(0)  # an unclosed head ends here
        elif tag in BLOCK:  # an open paragraph ends where a block starts; items end at the next item
            while self._blocks and ((top := self._stack[self._blocks[-1]][0]) == "p" or top in CELLS and tag in CELLS and top != "tr"):
                self._pop(self._blocks[-1])
        self._push(tag, attrs)
        if tag in RAW:  # only its own end tag ends such an element
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            return end.start() if end else len(html)
        return at


def surges(weights: np.ndarray, window: int, threshold: float) -> list[tuple[int, int]]:
    """Ranges of lines from where the sum of the next ``window`` weights surges above the threshold to where it dives to zero."""
    found, start = [], None
    for i, s in enumerate(window_sums(weights, window).tolist()):
        if start is None and s >= threshold and weights[i] > 0:
            start = i
        elif start is not None and s <= 0:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(weights)))
    return found


def window_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """The sum of each weight and of those after it, ``window`` in all."""
    ends = np.concatenate([[0.0], np.cumsum(weights), np.full(window, weights.sum())])
    return ends[window : window + len(weights)] - ends[: len(weights)]


def line_weights(lines: list[_Line], texts: list[str], marked: list[bool], titled: set[int]) -> tuple[list[float], list[bool]]:
    """What each line says for its being text of the article, and whether a scope raises it.

    A line weighs its characters less twice those in links, short legal lines nothing, lines of doubtful names half,
    marked ones nothing. A scope is trusted if it has a main heading, or is the only one, or holds a third of what is not
    marked (the only scope is not if there is over five times as much outside). Its lines weigh
    twelve times their characters outside links, those outside it a tenth; surge and dive decide on all of them alike.
    """
    plain = [0.0 if m or len(t) < 100 and LEGAL.match(t) else max(0, len(t) - 2 * x.links) * (0.5 if x.doubt else 1.0) for x, t, m in zip(lines, texts, marked)]
    held: dict[int, int] = {}
    for x, t, m in zip(lines, texts, marked):
        if not m:
            held[x.scope] = held.get(x.scope, 0) + len(t)
    whole, outside, scopes = sum(held.values()), held.get(0, 0), len(held) - (0 in held)
    trusted = {s for s, n in held.items() if s and (s in titled or 3 * n >= whole or scopes == 1 and outside <= 5 * (n + 50))}
    if not trusted:
        return plain, [False] * len(lines)
    raised = [SCOPE_WEIGHT * max(0, len(t) - 2 * x.links) for x, t in zip(lines, texts)]
    high = [x.scope in trusted and not m for x, m in zip(lines, marked)]
    return [r if h else w / 10 for h, w, r in zip(high, plain, raised)], high


def _ranges(lines: list[_Line], weights: list[float], high: list[bool], marked: list[bool], window: int, surge: int, share: float) -> list[int]:
    """The lines in the ranges that are kept: those of raised lines, and those of at least ``share`` of the heaviest.

    Depth of markup between blocks parts them, and so do the bounds of scopes. Marked lines within a scope are not there for the
    sums, so that what stands between two of its lines does not part them.
    """
    spaced, at, raised = [], [], set()
    for i, (x, w) in enumerate(zip(lines, weights)):
        if x.scope and marked[i]:
            at.append(-1)
            continue
        if i and lines[i - 1].scope != x.scope:
            spaced += [0.0] * window
        elif not x.scope:
            spaced += [0.0] * min(window, max(0, (x.gap - 2) // 2))
        if high[i]:
            raised.add(len(spaced))
        at.append(len(spaced))
        spaced.append(w)
    every = np.array(spaced, float)
    highest = float(window_sums(every, window).max(initial=0))
    ranges = surges(every, window, min(surge, highest / 2)) if highest else []
    total = np.concatenate([[0.0], np.cumsum(every)])
    sums = [float(total[b] - total[a]) for a, b in ranges]
    inside, heaviest = np.zeros(len(every) + 1, bool), max(sums, default=0.0)
    for (a, b), s in zip(ranges, sums):
        if a in raised or s >= share * heaviest:
            last = b - 1
            while every[last] <= 0:  # what has no weight at the end of a range is not between two lines of text
                last -= 1
            inside[a : last + 1] = True
    return [i for i, p in enumerate(at) if p >= 0 and inside[p]]


def main_text(html: str | None, window: int = 3, surge: int = 90, share: float = 0.1) -> str:
    """The main text of one page, its blocks joined by newlines; empty for null, empty and textless pages.

    Where the names leave nothing, those of layout that hold most of the page's text are disregarded.
    """
    if not html:
        return ""
    page = _Page(html)
    texts = [" ".join("".join(x.parts).split()) for x in page.lines]
    lines = [x for x, t in zip(page.lines, texts) if t]
    texts = [t for t in texts if t]
    while True:
        live = [False] * len(page.around)
        for n in range(1, len(live)):  # a mark holds if it or one around it does
            live[n] = not page.cleared[n] or live[page.around[n]]
        marked = [live[x.mark] for x in lines]
        weights, high = line_weights(lines, texts, marked, page.titled)
        kept = [i for i in _ranges(lines, weights, high, marked, window, surge, share) if not marked[i]]
        if kept or not any(marked):
            return "\n".join(texts[i] for i in kept)
        held = [0] * len(page.around)
        for x, t in zip(lines, texts):
            held[x.mark] += len(t)
        for n in range(len(held) - 1, 0, -1):
            held[page.around[n]] += held[n]
        most = [n for n in range(1, len(held)) if not page.cleared[n] and page.kind[n] == "layout" and 2 * held[n] > held[0] > 200]
        if not most:
            return ""
        for n in most:
            page.cleared[n] = True


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows of ``pages`` as ``page_id, url, text, n_chars``; a null html has an empty text.

    Whole pages are read, in time that grows with their length whatever their markup; repeated rows are returned each,
    null ids and urls stay null; an empty table gives an empty result; other columns are not read.
    """

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
