"""Main text of HTML pages.

The events of the standard library's parser are read once, as a stream, into lines: a line is the text of one block, with
the tags that it holds. On every page the ratio of text to tags of each line, smoothed by a Gaussian over its neighbours, is
split into two clusters, and the regions with lines of the upper one are the content. Elements and names that mark
menus, notices, forms, comments and the like, and links, are evidence: text in them counts as none. What scripts, styles and the like
hold is not text at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import small_batches

#: Elements whose content is not shown as text.
_SILENT = frozenset("script style noscript template button select textarea svg math iframe object canvas audio video head label option datalist".split())
#: Elements that mark what surrounds an article.
_BESIDES = frozenset("nav header footer aside form menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block where they begin and end.
_BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words in class, id, role or aria-label names that mark what surrounds an article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer sidebar sidebars aside widget related recommended recommendations share sharing social"
    " comment comments commentlist disqus reply replies respond search searchbox login complementary contentinfo".split()
)
#: Of these, the ones that mark an article element as a reader's comment.
_REMARKS = frozenset("comment comments reply replies respond".split())
#: Words that make a header one of the article itself.
_OWN = frozenset("entry post article story title".split())
#: First words of a name that says what a container has beside its content.
_BESIDE = frozenset("with has no without".split())
_OPENS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "html", "body"}
#: An end that may be left out: these are closed by a new one of their kind.
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "select", "html", "body", "article", "section", "div", "main"))
_P_SCOPE = _SCOPE | {"button"}


def _names_boilerplate(attrs: list[tuple[str, str | None]], names: frozenset[str] = _NAMES) -> bool:
    for key, value in attrs:
        if value and key in ("class", "id", "role", "aria-label"):
            for name in value.split():
                words = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
                if not _OWN.isdisjoint(words):
                    words.discard("header")
                if not names.isdisjoint(words) and _BESIDE.isdisjoint(words):
                    return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and re.search(r"display\s*:\s*none", value)):
            return True
    return False


@dataclass
class Line:
    """Text of one block."""

    text: str
    tags: int
    linked: int  # characters in links
    marked: bool  # in an element that is marked as no content
    home: int  # number of the article that holds it, else less than 0: that of the container
    heading: bool


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset(("div", "section", "td", "body", "blockquote", "li"))


class Blocks(HTMLParser):
    """The lines of a page. Every event costs the same however deep elements are nested: open elements are found by tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, is silent, is marked, is an article
        self.open: dict[str, list[int]] = {}  # where each tag is on the stack
        self.homes: list[tuple[int, int]] = [(-1, -1)]  # (depth, number) of the containers around
        self.silent = self.marked = self.articles = self.links = self.headings = 0
        self.numbers = {"article": 0, "container": -1}
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[Line] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            home = self.numbers["article"] if self.articles else self.homes[-1][1]
            self.lines.append(Line(text, self.tags, self.linked, self.marked > 0, home, self.headings > 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def _pop(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            tag, silent, marked, article = self.stack.pop()
            self.open[tag].pop()
            self.silent -= silent
            self.marked -= marked
            self.articles -= article
            self.links -= tag == "a"
            self.headings -= tag in _HEADINGS
            if self.homes[-1][0] == len(self.stack):
                self.homes.pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _close(self, tags: Iterable[str], scope: Iterable[str]) -> None:
        at = self._last(tags)
        if at >= 0 and at >= self._last(scope):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag in _OPENS_P:
            self._close(("p",), _P_SCOPE)
        elif tag in _CLOSED_BY:
            self._close(_CLOSED_BY[tag], _SCOPE)
        if tag == "body":
            self._close(("head",), ())
        article = tag in ("article", "main")
        silent = tag in _SILENT
        marked = tag in _BESIDES and not (tag == "header" and self.articles)
        if not marked and not silent and attrs and tag not in ("html", "body", "main"):
            marked = _names_boilerplate(attrs, _REMARKS if tag == "article" else _NAMES)
        if marked and not self.marked:
            self.flush()
        if article and not self.articles:
            self.numbers["article"] += 1
        elif tag in _CONTAINERS:
            self.numbers["container"] -= 1
            self.homes.append((len(self.stack), self.numbers["container"]))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, silent, marked, article))
        self.silent += silent
        self.marked += marked
        self.articles += article
        self.links += tag == "a"
        self.headings += tag in _HEADINGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
        if not self.open.get(tag):
            return
        at = self.open[tag][-1]
        if self.marked and any(t[2] for t in self.stack[at:]):
            self.flush()
        self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.flush()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the ends held."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values are in the upper of two clusters: of all thresholds that with the most variance between its sides.

    Values count by their logarithm, as text is more dense than boilerplate by factors. Equal values are one cluster, the upper.
    """
    x = np.log1p(values)
    at = np.unique(x)
    if len(at) < 2:
        return np.ones(len(x), bool)
    order = np.sort(x)
    below = np.arange(1, len(x))
    means = np.cumsum(order)[:-1] / below, (order.sum() - np.cumsum(order)[:-1]) / below[::-1]
    spread = np.where(order[1:] > order[:-1], below * below[::-1] * (means[0] - means[1]) ** 2, -1)
    return x >= order[spread.argmax() + 1]


def content(lines: list[Line], sigma: float = 1.0) -> list[str]:
    """The lines of the content regions, in page order.

    A line is dense when its smoothed ratio of text (unmarked and outside links) to tags is in the upper cluster of its page
    and its own text is neither marked nor mostly links. A region is an article, or a container outside articles. Those with a
    dense line whose own ratio is as high are content (smoothing alone would let short lines beside long text in): an article
    whole; a container from its first dense line, or the headings before it, to its last, but for marked lines. Containers
    that hold less than half as much dense text as the articles kept are left out. If nothing is dense, articles are kept.
    """
    lines = list(lines)
    if not any(not x.marked for x in lines):
        return []
    marked, size, linked = (np.array([getattr(x, k) if k != "size" else len(x.text) for x in lines]) for k in ("marked", "size", "linked"))
    home = np.array([x.home for x in lines])
    ratio = np.where(marked, 0, size - linked) / np.maximum(1, np.array([x.tags for x in lines]))
    level = smooth(ratio, sigma)
    dense = upper_cluster(level) & ~marked & (2 * linked <= size)
    # the cut between the clusters, for lines by themselves
    cut = level[dense].min(initial=np.inf)
    regions = np.unique(home[dense & (ratio >= cut)])
    inside = np.isin(home, regions[regions > 0]) & ~marked
    outside = np.zeros(len(lines), bool)
    loose = dense & (home < 0) & np.isin(home, regions)
    if 2 * size[loose].sum() >= size[dense & inside].sum():
        # first and last dense line of each container
        which, at = np.unique(home[loose], return_inverse=True)
        place = np.flatnonzero(loose)
        first, last = np.full(len(which), len(lines)), np.zeros(len(which), np.int64)
        np.minimum.at(first, at, place)
        np.maximum.at(last, at, place)
        of = np.searchsorted(which, home)
        known = np.flatnonzero((of < len(which)) & np.isin(home, which))
        outside[known] = (known >= first[of[known]]) & (known <= last[of[known]]) & ~marked[known]
    for k in range(len(lines) - 2, -1, -1):
        outside[k] |= lines[k].heading and home[k] < 0 and not marked[k] and outside[k + 1] and 2 * linked[k] <= size[k]
    kept = inside | outside
    if not kept.any():
        kept = (home > 0) & ~marked
    return [x.text for x, keep in zip(lines, kept.tolist(), strict=True) if keep]


_TAG = re.compile(r"<[a-zA-Z/!?]")


def main_text(html: str | None) -> str:
    """The main text of a page, one line for each block; empty for null or a page without text."""
    if not html:
        return ""
    parser = Blocks()
    # a tag that the page ends in is none; without its end the parser would look for one from each "<" on
    open_end = _TAG.search(html, html.rfind(">") + 1)
    parser.feed(html[: open_end.start()] if open_end else html)
    parser.close()
    return "\n".join(content(parser.lines))


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars (code points) of every row's whole html.

    Null or empty html, and pages without main text, give an empty text. Rows are taken one by one, so repeated and null
    keys stay as they are; other columns are not read.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(key), "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"`{key}` {kinds[key]}, url {kinds['url']}, text string, n_chars long")
