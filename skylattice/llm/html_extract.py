"""Main text of web pages from text-to-tag ratios.

One pass of the standard library's streaming parser turns a page into lines, one for each stretch of text between block
boundaries, with its tag and link counts. Each line's ratio of own text (without link text) to tags is smoothed over
its neighbours with a Gaussian; two-means clustering of the smoothed ratios sets the threshold between content and
boilerplate. A line above it is content, and it votes for where the page's content is if its own ratio is not far below
the threshold, so that a short line beside a long text does not count as one. The smallest container of all votes holds
the content: its own lines are kept, short ones too, and so are the containers in it from the first to the last one with
a vote, except those without one that are mostly links. Names raise or lower lines: where a page has article or main
elements that hold at least half of the content, all outermost ones with text are kept instead, but those marked as
boilerplate only if the one with the most text is marked as well; lines in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments, known from the elements' names and attributes, have no weight.

Defined results: null, empty and text-free html give an empty text; text outside of all elements counts as a block;
lines of one ratio are all content; a page without a voting line keeps all its lines with weight; a page of any length
is parsed as a whole; repeated and null page ids are separate rows; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.storage import small_batches

#: Elements that begin and end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content of the article.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input menu nav noscript object option script select style svg "
    "template textarea video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role that mark an element as boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist discussion disqus replies respond cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget widgets pagination pager skip search copyright contentinfo complementary".split()
)
ARTICLE = frozenset({"article", "main"})
#: Elements that hold a page's blocks; others, like p, h1, li and inline ones, are parts of one.
CONTAINERS = frozenset("article blockquote body center details div dl fieldset figure html main ol section table tbody td ul".split())
SIBLINGS = frozenset({"p", "li", "td", "th", "tr", "option", "dt", "dd"})
_COMMENT = frozenset("comment comments commentlist discussion disqus replies respond".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
SIGMA = 1.5


@dataclass(slots=True)
class Line:
    parents: tuple[int, ...]  # numbers of the open elements, outermost first
    dropped: bool
    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0


class PageLines(HTMLParser):
    """Collects a page's lines from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, str]] = []  # tag, number, why it is dropped ("" where it is not)
        self.count = self.links = self.drops = 0  # elements so far; open links; open elements that are dropped
        self.containers: set[int] = set()
        self.articles: dict[int, int] = {}  # outermost ones: 0, or 1 in a marked wrapper, or 2 if marked itself
        self.wrappers: set[int] = set()  # marked elements around articles
        self.current = Line((), False)

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    def _line(self) -> None:
        if self.current.text:
            self.lines.append(self.current)
        self.current = Line(tuple([n for _, n, _ in self.open]), self.drops > 0)

    def close(self):
        super().close()
        self._line()

    def _cut(self, k: int) -> bool:
        """Closes the open elements from the ``k``-th on; whether that ends a line."""
        closed = self.open[k:]
        del self.open[k:]
        ends = False
        for tag, _, why in closed:
            self.links -= tag == "a"
            self.drops -= why != ""
            ends = ends or why != "" or tag in BLOCKS
        return ends

    def _why(self, tag: str, attrs: list) -> str:
        if tag in DROPPED:
            return "element"
        if tag in ("html", "body") or tag in ARTICLE and not any(t in ARTICLE for t, *_ in self.open):
            return ""
        if tag == "header" and not any(t in ARTICLE for t, *_ in self.open):
            return "element"
        return self._mark(attrs)

    def _mark(self, attrs: list) -> str:
        if not attrs:
            return ""
        values = dict(attrs)
        if "hidden" in values or values.get("aria-hidden") == "true":
            return "mark"
        words = {w.lower() for k in ("class", "id", "role") for w in _WORD.findall(values.get(k) or "")}
        return "comment" if words & _COMMENT else "mark" if words & MARKS else ""

    def handle_starttag(self, tag, attrs):
        self.current.tags += 1
        if tag in VOID:
            if tag == "br":
                self.current.text.append(" ")
            elif tag == "hr":
                self._line()
            return
        if tag in SIBLINGS:  # ended by the next of its kind
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self._cut(k)
                if k >= len(self.open) or self.open[k][0] in BLOCKS:
                    break
        elif tag in ARTICLE and self.drops and not any(why == "comment" for *_, why in self.open):
            self.wrappers |= {n for _, n, why in self.open if why == "mark"}
            self.open = [(t, n, "" if why == "mark" else why) for t, n, why in self.open]  # a wrapper of the article
            self.drops = sum(why != "" for *_, why in self.open)
        self.count += 1
        why = self._why(tag, attrs)
        if tag in CONTAINERS:
            self.containers.add(self.count)
        if tag in ARTICLE and not any(t in ARTICLE for t, *_ in self.open):
            self.articles[self.count] = 2 if self._mark(attrs) else int(any(n in self.wrappers for _, n, _ in self.open))
        self.open.append((tag, self.count, why))
        self.links += tag == "a"
        self.drops += why != ""
        if why or tag in BLOCKS:
            self._line()
            self.current.tags += 1

    def handle_endtag(self, tag):
        self.current.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self._cut(k):
                    self._line()
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.current.text.append(data)
        if self.links:
            self.current.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, with the kernel's weights outside of the page left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = lambda x: np.convolve(x, kernel, mode="full")[reach : reach + len(x)]
    return whole(ratios) / whole(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of ``values`` (two-means from the extremes); below all if they are alike."""
    low, high = values.min(), values.max()
    if high <= 2 * low:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        above = values > cut
        new = values[~above].mean(), values[above].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def voting(own: np.ndarray, tags: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are content, and which of them vote, from their own text, their tags and whether they have weight."""
    ratio = own / np.maximum(tags, 1)
    smooth = smoothed(ratio)
    cut = threshold(smooth[free])
    content = free & (smooth >= cut)
    return content, content & (own > 0) & (ratio >= cut / 2)


def _content(lines: list[Line], own: np.ndarray, votes: np.ndarray, containers: set[int]) -> list[bool]:
    """Which lines lie where the votes say that the content is."""
    inside = [[n for n in line.parents if n in containers] for line in lines]
    around = set.intersection(*[set(inside[k]) for k in np.flatnonzero(votes)])
    top = max(around, default=0)  # the innermost container of all votes, if there is one
    # the outermost container of each line within it; 0 for its own lines, -1 for those outside of it
    part = [-1 if top and top not in c else next((n for n in c if n > top), 0) for c in inside]
    voted = {part[k] for k in np.flatnonzero(votes)}
    numbers = [k for k, p in enumerate(part) if p in voted]
    text: dict[int, list[float]] = {}
    for line, p, w in zip(lines, part, own):
        sums = text.setdefault(p, [0.0, 0.0])
        sums[0], sums[1] = sums[0] + w, sums[1] + line.linked
    between = lambda k: numbers[0] < k < numbers[-1] and text[part[k]][0] > text[part[k]][1]
    return [p >= 0 and (p == 0 or p in voted or between(k)) for k, p in enumerate(part)]


def main_text(html: str | None) -> str:
    """The page's main text, its blocks joined by line feeds."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    found = [(line, _SPACE.sub(" ", "".join(line.text)).strip()) for line in page.lines]
    found = [(line, text) for line, text in found if text]
    lines = [line for line, _ in found]
    free = np.array([not line.dropped for line in lines], dtype=bool)
    if not free.any():
        return ""
    own = np.array([0 if line.dropped else max(0, len(text) - line.linked) for line, text in found], dtype=np.float64)
    content, votes = voting(own, np.array([line.tags for line in lines]), free)
    weight: dict[int, float] = {}
    for line, w in zip(lines, own):
        for parent in line.parents:
            if parent in page.articles:
                weight[parent] = weight.get(parent, 0.0) + w
    in_article = np.array([not page.articles.keys().isdisjoint(line.parents) for line in lines], dtype=bool)
    inside = own[content & in_article].sum()
    kept = free
    if inside and 2 * inside >= own[content].sum():
        most = page.articles[max(weight, key=lambda n: (weight[n], -n))]
        holders = {n for n, w in weight.items() if w > 0 and page.articles[n] <= most}
        kept = free & np.array([not holders.isdisjoint(line.parents) for line in lines])
    elif votes.any():
        kept = free & np.array(_content(lines, own, votes, page.containers))
    return "\n".join(text for (_, text), yes in zip(found, kept) if yes)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; each task parses its pages one by one."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
