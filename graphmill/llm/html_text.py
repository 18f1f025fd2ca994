"""Main text of web pages by tree scoring.

A page is read into a tree of block elements. Paragraphs pass points for their
length and commas to the elements above them, halved at each step; an element's
points are discounted by its share of link text. The best container is kept,
with siblings that score well themselves.

Menus, headers, footers, sidebars, notices, adverts, scripts, styles and reader comments
never take part, whether their element tells so or a class, id or role that is made of such
words alone (a heading's own class aside). A name of which only a part is such a word
("site-footer", "comments-area") removes an element that holds less than a third of the page's
text and no article, a larger one gets half of the points; a part that names reader comments
always removes, and a name that tells a state ("has-sidebar", "ad-free") says nothing. A form
doesn't take part either, unless it holds half of the page's text or more: then it wraps the
page and is a container like any other. Words that often name boilerplate (sharing, related,
social, ...) cost their element points: within the best container such an element stays only if
its paragraphs outweigh them.

Defined results: a null or empty page, or one without text, gives an empty string
and 0; null ids and urls pass through; unclosed and stray tags are tolerated. The time is
linear in the page, whatever its tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""["'>]""")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")

# Element names and words in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside button dialog footer head header menu nav".split())
FORM = frozenset(["form", "fieldset"])
PARAGRAPH = frozenset("blockquote dd p pre td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo "
    "cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation notice notices popup respond sidebar "
    "sponsor sponsored toolbar topbar".split()
)
DOUBTFUL = frozenset(
    "login newsletter pager pagination promo promoted promotion recommended related replies reply search share sharing signup skip "
    "social subscribe widget widgets".split()
)
REMARKS = frozenset("comment comments commentlist disqus respond".split())
#: Parts of a name that make it tell a state of the page, not what its element holds.
STATES = frozenset("no not non has have with without is free off on open closed fixed sticky enabled disabled active layout theme".split())
#: Points that a word of DOUBTFUL costs, the share of a page's text that makes a form a container, and the one that is too large for boilerplate.
DOUBT, WRAPPER, LARGE = 25.0, 0.5, 1 / 3
#: An open element that a start tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PRIOR = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 3.0, "td": 2.0, "ul": -3.0, "ol": -3.0, "li": -3.0}
MIN_PARAGRAPH = 25
P = frozenset(["p"])
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def judged(tag: str, attributes: str) -> str:
    """What an element's tag, class, id and role make of it: "dropped", "form", "partly" (boilerplate if small), "doubtful" or ""."""
    if tag in DROPPED:
        return "dropped"
    if attributes and tag not in ("html", "body", "article", "main"):
        if HIDDEN.search(attributes):
            return "dropped"
        names = [frozenset(filter(None, SPLIT.split(name))) for m in NAMES.findall(attributes) for name in "".join(m).lower().split()]
        names = [parts for parts in names if parts and not parts & STATES]
        if tag not in HEADING and any(parts <= BOILERPLATE or parts & REMARKS for parts in names):
            return "dropped"
        if tag in BLOCK and tag not in HEADING and tag not in FORM:
            words = frozenset().union(*names)
            return "form" if "form" in words else "partly" if words & BOILERPLATE else "doubtful" if words & DOUBTFUL else ""
    return "form" if tag in FORM else ""


def tags(html: str, behind: list[int]) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, comment or declaration (no name), in one pass.

    The reader may move on to ``behind[0]`` after any of them, past the raw text of a script or its like.
    A quote without an end is an ordinary character. Once a tag has no end outside quotes, quotes are ignored.
    """
    at, n, quotes = 0, len(html), {'"': True, "'": True}
    while (start := html.find("<", max(at, behind[0]))) >= 0:
        named = NAME.match(html, start + 1)
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if not named:
            if html[start + 1 : start + 2] not in ("!", "?", "/") or not html[start + 1 : start + 2]:
                at = start + 1
                continue
            end = html.find(">", start)
        else:
            end, place = -1, named.end()
            while stop := STOP.search(html, place):
                place = stop.end()
                if stop[0] == ">":
                    end = stop.start()
                    break
                if quotes[stop[0]]:
                    close = html.find(stop[0], place)
                    quotes[stop[0]] = close >= 0
                    place = close + 1 if close >= 0 else place
            if end < 0:
                quotes = {'"': False, "'": False}
                end = html.find(">", named.end())
        if end < 0:
            return
        at = end + 1
        yield start, at, named[1].lower() if named else "", html[start + 1] == "/", html[named.end() : end] if named else ""


class Page:
    """Block elements in page order (tag, parent, verdict) and the text blocks in them."""

    def __init__(self, html: str):
        self.tags, self.parents, self.verdicts = ["#page"], [-1], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._links = 0
        self._read(html)

    def _flush(self, node: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((node, text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def _read(self, html: str) -> None:
        self.open: list[tuple[str, int, bool]] = []  # tag, block element it lies in, dropped
        self.places: dict[str, list[int]] = {}  # places of each tag among the open ones
        self.block_places: list[int] = []
        self.node, self.dropped = 0, False
        at, behind = 0, [0]
        for start, end, tag, closing, attributes in tags(html, behind):
            self._add(html[at:start])
            at = end
            if not tag:
                continue
            if closing:
                if self.places.get(tag):
                    self._close(self.places[tag][-1])
                continue
            if tag in RAW:
                found = RAW_END[tag].search(html, end)
                behind[0] = at = found.end() if found else len(html)
                continue
            if tag in VOID:
                if not self.dropped:
                    self._text.append(" ")
                    if tag == "hr":
                        self._flush(self.node)
                continue
            if tag in BLOCK:
                self._close_before(tag)
            self._start(tag, attributes)
        self._add(html[at:])
        if not self.dropped:
            self._flush(self.node)

    def _add(self, text: str) -> None:
        if text and not self.dropped:
            text = unescape(text)
            self._text.append(text)
            if self.places.get("a"):
                self._links += len(text.strip())

    def _close_before(self, tag: str) -> None:
        """Close what a start tag ends: an open paragraph, or an item or cell of its kind."""
        closing = CLOSES.get(tag, P)
        for k in reversed(self.block_places):
            name = self.open[k][0]
            if name in closing:
                self._close(k)
                if tag != "tr":
                    return
            elif name not in ("td", "th", "tr"):
                return

    def _start(self, tag: str, attributes: str) -> None:
        place, verdict = len(self.open), judged(tag, attributes)
        self.open.append((tag, self.node, self.dropped))
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.block_places.append(place)
            if not self.dropped:
                self._flush(self.node)
                self.tags.append(tag)
                self.parents.append(self.node)
                self.verdicts.append(verdict)
                self.node = len(self.tags) - 1
        self.dropped = self.dropped or verdict == "dropped"

    def _close(self, k: int) -> None:
        """Close the open element k and all within it."""
        if not self.dropped and (self.block_places and self.block_places[-1] >= k):
            self._flush(self.node)
        _, self.node, self.dropped = self.open[k]
        for place in range(len(self.open) - 1, k - 1, -1):
            tag = self.open[place][0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.block_places.pop()
        del self.open[k:]


def summed(page: Page, own: list[float]) -> list[float]:
    """For each element, its own numbers and those of all elements in it."""
    total = list(own)
    for k in range(len(total) - 1, 0, -1):
        total[page.parents[k]] += total[k]
    return total


def main_text(html: str | None) -> str:
    """The page's article, one line a block."""
    if not html:
        return ""
    page = Page(html)
    n = len(page.tags)
    held = [0] * n
    for node, text, _ in page.blocks:
        held[node] += len(text)
    held = summed(page, held)
    articles = summed(page, [float(tag in ("article", "main")) for tag in page.tags])
    out = [False] * n  # in boilerplate, or in a form that doesn't wrap the page
    verdicts = list(page.verdicts)
    for k in range(1, n):
        if verdicts[k] == "partly":
            verdicts[k] = "dropped" if held[k] < LARGE * held[0] and not articles[k] else "large"
        out[k] = out[page.parents[k]] or verdicts[k] == "dropped" or verdicts[k] == "form" and held[k] < WRAPPER * held[0]
    points, chars, linked = [0.0] * n, [0] * n, [0] * n
    scored = [False] * n
    for node, text, links in page.blocks:
        if out[node]:
            continue
        chars[node] += len(text)
        linked[node] += links
        if len(text) < MIN_PARAGRAPH or page.tags[node] in HEADING:
            continue
        worth = 1.0 + text.count(",") + min(len(text) / 100, 3.0)
        at = page.parents[node] if page.tags[node] in PARAGRAPH or page.tags[node] == "li" else node
        share = 1.0
        for _ in range(4):
            if at < 0:
                break
            points[at] += worth * share
            scored[at] = True
            at, share = page.parents[at], share / 2
    chars, linked = summed(page, chars), summed(page, linked)
    density = [linked[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    prior = [PRIOR.get(tag, 0.0) - DOUBT * (verdict == "doubtful") for tag, verdict in zip(page.tags, verdicts, strict=True)]
    worth = [points[k] * (0.5 if verdicts[k] == "large" else 1) + prior[k] for k in range(n)]
    score = [worth[k] * (1 - density[k]) if scored[k] else 0.0 for k in range(n)]
    best = max(range(n), key=lambda k: (score[k], -k)) if any(scored) else 0
    at = best
    while at > 0:  # an article's parts belong together
        if page.tags[at] in ("article", "main"):
            best = at
        at = page.parents[at]
    kept = [False] * n
    least = max(10.0, 0.2 * score[best])
    for k in range(n):
        up = page.parents[k]
        if k == best or up >= 0 and kept[up]:
            kept[k] = k == best or verdicts[k] != "doubtful" or score[k] > 0
        elif best and up == page.parents[best] and verdicts[k] != "doubtful":
            paragraph = page.tags[k] in PARAGRAPH and (chars[k] > 80 and density[k] < 0.25 or 0 < chars[k] and density[k] == 0)
            kept[k] = score[k] >= least or paragraph or page.tags[k] in HEADING and density[k] < 0.33
    return "\n".join(text for node, text, _ in page.blocks if kept[node] and not out[node])


def extract(pages: DataFrame) -> DataFrame:
    """Main text and its length in code points, of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column("html").to_pylist()]
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                }
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, SCHEMA)
