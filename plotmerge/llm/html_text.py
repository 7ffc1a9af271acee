"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block of the page; scripts, styles, comments, hidden
elements and those whose element name or role says menu, header, footer, aside, form or
notice leave a gap of blank lines. Lines are dealt to classes by what holds them: an article,
main without it, neither, or a container that a class or id calls advert, comments and the
like. In each class the text lengths of every ``WINDOW`` lines in a row are summed. Between
two sums of zero lies one stretch of text; it counts from the point where its sums, times
the weight of the class, surge to ``SURGE`` to the point where they dive to zero, and it is
kept whole, so short paragraphs inside stay. The innermost mark has the weight ``MARK``, so
nearly any text in it surges; where it holds less than the rest of main, it marks teasers,
and main weighs 1. Other lines weigh 1 on pages without marks, less in main beside larger
articles, and outside marks nothing, unless the marked text is at most ``OUTSIDE`` of theirs and so
marks teasers too. Outside the innermost mark, lines that are mostly links count as blank. A stretch
that does not surge stays if its neighbour does and has the same container.

Cued containers are out, however long. A doubtful cue (a word such as 'social' or 'notice' by itself
or beside words that name no container, as in 'social-history') puts out lists of links and
short lines only: a container that holds prose counts as any other. If nothing surges, cued
containers count as any other, and at last the highest stretch without a cue.

Defined results: null html is empty and gives an empty text; unclosed elements, comments
and tags end where HTML ends them, at the latest with the page; repeated rows are each
extracted; an empty table gives no rows. Each character is scanned a bounded number of
times. Columns other than the three named are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import whole_text

#: Lines of one window; blank lines that an element which is left out leaves behind.
WINDOW = 3
#: Characters in a window from which on a stretch of an unmarked page is text.
SURGE = 80
#: Weights: in the innermost mark, of main beside larger articles.
MARK, BESIDE = SURGE, 1 / 4
#: Marks that hold at most this share of the text outside them mark teasers.
OUTSIDE = 1 / 16
#: Share of a line's characters inside links that makes it a menu line.
LINKS = 0.6

# Element names of HTML, and common words in class and id names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"nav", "footer", "aside", "form", "head", "button", "dialog", "menu"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p",
    "pre", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
INLINE = {
    "a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "canvas", "cite", "code", "data", "del", "dfn", "em",
    "font", "i", "ins", "kbd", "label", "map", "mark", "meter", "nobr", "output", "picture", "progress", "q", "rp",
    "rt", "ruby", "s", "samp", "slot", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "video",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
CUES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "comment",
    "comments", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social",
    "related", "recommended", "widget", "toolbar", "pagination", "pager", "masthead", "topbar", "skip", "copyright",
}
HEADER_CUES = {"header"}
#: Cues that are also words of a subject, and words for containers that make them plain again.
DOUBTFUL = {
    "promo", "promotion", "banner", "notice", "notices", "alert", "share", "sharing", "social", "related",
    "recommended", "widget", "toolbar", "skip", "overlay", "copyright", "login", "menu", "consent", "header",
}
GENERIC = {
    "list", "box", "block", "area", "section", "container", "wrap", "slot", "unit", "item", "items", "link", "links",
    "button", "buttons", "icon", "icons", "bar", "post", "posts", "article", "articles", "story", "stories", "form",
    "panel", "inner", "outer", "tools", "media", "module", "site", "top", "bottom", "left", "right", "main",
}
#: Words beside 'widget' with which a page builder names the parts of an article.
CONTENT_WORDS = {"content", "article", "entry", "post", "story", "text", "heading", "title"}
PARAGRAPHS = {"p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6"}
LAYOUT_WORDS = {"has", "no", "with", "without", "layout", "wrapper", "page"}
MARKED = {"article": 2, "main": 1}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""\shidden(?=[\s>/=])|display\s*:\s*none""", re.I)
_HREF = re.compile(r"""[\s"'/]href\s*=""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tag_end(html: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Behind the ``>`` that ends the tag at ``at``; quoted attributes may hold one."""
    end = html.find(">", at)
    if end < 0:
        return len(html), quotes
    open_at = at
    while quotes:
        spots = [s for s in (html.find('="', open_at, end), html.find("='", open_at, end)) if s >= 0]
        if not spots:
            break
        first = min(spots) + 1
        close = html.find(html[first], first + 1)
        if close < 0:  # an unclosed quote: no later tag needs to look for its end again
            quotes = False
            break
        open_at = close + 1
        if close > end:
            end = html.find(">", close)
            if end < 0:
                return len(html), quotes
    return end + 1, quotes


def _sure(words: set[str]) -> int:
    """1 if a name with a cue is one whatever it holds, 2 if it may name a subject."""
    cues = words & (CUES | HEADER_CUES)
    return 1 if cues - DOUBTFUL or words - cues and not words - cues - GENERIC else 2


def _left_out(name: str, tag: str, marked: int) -> tuple[bool, int]:
    """Whether an element is left out, and whether its class or id is a cue against it (2: doubtful)."""
    if name in LEFT_OUT or name == "header" and not marked:
        return True, 0
    if "=" not in tag and "hidden" not in tag or name in ("html", "body"):
        return False, 0
    if _HIDDEN.search(tag):
        return True, 0
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag)}
    if given.get("role", "").lower() in ROLES:
        return True, 0
    doubtful = 0
    for names in (given.get("class", "").split(), given.get("id", "").split()):
        for one in names:
            words = {w.lower() for w in _WORD.findall(one)}
            cues = words & CUES
            if cues == {"widget"} and words & CONTENT_WORDS:
                continue
            if cues and not words & LAYOUT_WORDS:
                if name not in MARKED or words & {"comment", "comments", "reply"}:
                    doubtful = _sure(words)
            elif words & HEADER_CUES and not marked and name not in MARKED and not words & LAYOUT_WORDS:
                doubtful = 1 if words <= HEADER_CUES else _sure(words)
            if doubtful == 1:
                return False, 1
    return False, doubtful


def lines_of(html: str) -> list[tuple[str, int, int, bool, int]]:
    """(text, characters inside links, mark, cue, container) of each block; left-out elements are gaps."""
    lines: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    stack: list[list] = []  # name (empty once ended inside an open block), left out, mark, link, cue
    where: dict[str, list[int]] = {}  # places of the open elements of each name in the stack
    blocks: list[int] = []  # places of the open blocks
    holders = [0]  # open containers of paragraphs, numbered in their order
    opened = cued = 0  # containers so far; open elements with a sure cue
    doubts = [0]  # open elements with a doubtful cue, numbered in their order
    doubted = 0  # such elements so far
    prose = set()  # those that hold prose
    out = links = 0  # open elements that are left out; open links
    linked = 0
    mark = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                if len(text) >= SURGE and linked <= LINKS * len(text):
                    prose.update(doubts)
                lines.append((text, linked, mark, -1 if cued else doubts[-1], holders[-1]))
            parts.clear()
            linked = 0

    def pop() -> str:
        nonlocal out, links, mark, cued
        name, dropped, _, link, cue = stack.pop()
        if name:
            where[name].pop()
            if name in BLOCKS:
                blocks.pop()
                if name not in PARAGRAPHS:
                    holders.pop()
        out -= dropped
        cued -= cue == 1
        if cue > 1:
            doubts.remove(cue)
        links -= link
        mark = stack[-1][2] if stack else 0
        return name

    def close(name: str) -> None:
        """End the innermost open element of a name, at any depth."""
        nonlocal out, links, cued
        if not where.get(name):
            return
        k = where[name][-1]
        if name not in BLOCKS and blocks and blocks[-1] > k:  # blocks inside stay open
            where[name].pop()
            out -= stack[k][1]
            links -= stack[k][3]
            cued -= stack[k][4] == 1
            if stack[k][4] > 1:
                doubts.remove(stack[k][4])
            stack[k][0], stack[k][1], stack[k][3], stack[k][4] = "", False, False, 0
            return
        while len(stack) > k:
            pop()

    at, quotes, size = 0, True, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at and not out:
            parts.append(html[at:start])
            if links:
                linked += start - at
        if start == size:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        found = _NAME.match(html, start)
        if not found:
            if html.startswith(("<!", "<?", "</"), start):
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:  # a bare sign
                if not out:
                    parts.append("<")
                at = start + 1
            continue
        at, quotes = _tag_end(html, found.end(), quotes)
        name = found[1].lower()
        if html[start + 1] == "/":
            if name in BLOCKS:
                flush()
            close(name)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = size if end is None else _tag_end(html, end.end(), quotes)[0]
            continue
        if name == "br":
            if not out:
                parts.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
            while stack and stack[-1][0] not in BLOCKS:  # inline elements left open
                if stack[-1][1] or stack[-1][3] or stack[-1][4]:
                    break
                pop()
            if stack and stack[-1][0] == "p":
                pop()
            if name == "body":
                while stack and stack[-1][0] == "head":
                    pop()
            if name in SIBLINGS:
                pair = (name, {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}.get(name))
                before = max((where[n][-1] for n in pair if where.get(n)), default=-1)
                if before > max((where[n][-1] for n in SIBLINGS[name] if where.get(n)), default=-1):
                    while len(stack) > before:
                        pop()
        if name in VOID or html[at - 2 : at] == "/>" and not block and name not in INLINE | LEFT_OUT:
            continue
        if name == "a":
            close(name)
        link = name == "a" and _HREF.search(html, start, at) is not None
        dropped, cue = _left_out(name, html[start:at], mark)
        if dropped or cue:
            flush()
            lines.extend([("", 0, 0, 0, 0)] * WINDOW)
        mark = max(mark, MARKED.get(name, 0))
        where.setdefault(name, []).append(len(stack))
        if block:
            blocks.append(len(stack))
            if name not in PARAGRAPHS:
                opened += 1
                holders.append(opened)
        if cue == 2:
            doubted += 1
            cue = doubted + 1
            doubts.append(cue)
        stack.append([name, dropped, mark, link, cue])
        cued += cue == 1
        out += dropped
        links += link
    flush()
    return [(text, n, m, cue < 0 or cue > 0 and cue not in prose, holder) for text, n, m, cue, holder in lines]


def _stretches(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(first line, behind the last, highest window sum) between every two sums of zero."""
    # A gap on both sides; window k holds the lines k .. k + WINDOW - 1.
    padded = np.concatenate([np.zeros(WINDOW, int), lengths, np.zeros(WINDOW, int)])
    total = np.cumsum(padded)
    windows = total[WINDOW:] - total[:-WINDOW]
    dives = np.flatnonzero(windows == 0)
    spans = zip(np.append(-1, dives), np.append(dives, len(windows)), strict=True)
    return [(max(a + 1 - WINDOW, 0), min(b, len(lengths)), windows[a + 1 : b].max()) for a, b in spans if b > a + 1]


def _surging(lengths: np.ndarray, holders: np.ndarray, weight: float, surge: float) -> np.ndarray:
    """The lines of the stretches that surge, and of their neighbours in the same container."""
    spans, kept = _stretches(lengths), np.zeros(len(lengths), bool)
    good = [weight * top >= surge for _, _, top in spans]
    ends = []
    for a, b, _ in spans:
        full = a + np.flatnonzero(lengths[a:b])
        ends.append((holders[full[0]], holders[full[-1]]))
    joined = list(good)
    if any(good):
        for order in (range(1, len(spans)), range(len(spans) - 2, -1, -1)):
            for k in order:
                other = k - 1 if order.step > 0 else k + 1
                near, far = (ends[k][0], ends[other][1]) if order.step > 0 else (ends[k][1], ends[other][0])
                joined[k] = joined[k] or joined[other] and near == far
    for (a, b, _), keep in zip(spans, joined, strict=True):
        if keep:
            kept[a:b] = True
    return kept & (lengths > 0)


def main_text(html: str) -> str:
    lines = lines_of(html)
    if not lines:
        return ""
    texts, linked, marks, cues, holders = (list(c) for c in zip(*lines, strict=True))
    linked, marks, cues, holders = np.array(linked), np.array(marks), np.array(cues), np.array(holders)
    lengths = np.array([len(t) for t in texts])
    scope = int(marks[(lengths > 0) & ~cues].max(initial=0))
    sums = [int(lengths[(marks == m) & ~cues].sum()) for m in range(3)]
    teasers = scope == 2 and sums[1] > sums[2]  # articles that hold less than the rest of main

    outside_counts = sums[1] + sums[2] <= OUTSIDE * sums[0]

    def weight(m: int) -> float:
        if scope == 0 or m == 1 and teasers:
            return 1
        return MARK if m == scope else BESIDE if m else int(outside_counts)

    text = np.where(linked > LINKS * np.maximum(lengths, 1), 0, lengths)
    text[(marks == scope) & (scope > 0)] = lengths[(marks == scope) & (scope > 0)]
    kept = np.zeros(len(lines), bool)
    for m in range(3):
        kept |= _surging(np.where((marks == m) & ~cues, text, 0), holders, weight(m), SURGE)
    if not kept.any():
        kept = _surging(text, holders, 1, SURGE)
    if not kept.any():
        plain = np.where(cues, 0, text)
        top = max((t for _, _, t in _stretches(plain)), default=0)
        kept = _surging(plain, holders, 1, max(top, 1))
    return "\n".join(texts[k] for k in np.flatnonzero(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch[2]]
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    given = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), whole_text(html_col))
    return given.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
