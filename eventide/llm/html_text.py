"""Main text of web pages by smoothed text-to-tag ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements that never close.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is no part of an article.
_ASIDE = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input menu nav noscript object script select style "
    "svg template textarea title".split()
)
#: Words of class, id or role that mark such parts.
_MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup popover promo related replies "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside them in a name without changing what it says.
_PLAIN = frozenset("area bar block bottom box container content footer header inner left list main outer page panel right section site slot top unit wrap wrapper".split())
#: Elements that class words can mark: containers, never a paragraph, heading, quotation or table.
_MARKABLE = frozenset("center details div dl fieldset figure hgroup ins li nav ol section span table ul".split()) - {"table"}
#: Elements that hold blocks and may be a region of content.
_BOX = frozenset("article blockquote body center dd details div dl fieldset figure main ol section table td ul".split())
_WORD = re.compile(r"[a-z]+")
_CLOSES_P = _BLOCK - {"head", "html", "body"}


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a name in class, id or role marks a container: each name must consist of marking words, plain ones beside them."""
    if tag not in _MARKABLE:
        return False
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.lower().split():
                words = set(_WORD.findall(token))
                if words & _MARKS and words <= _MARKS | _PLAIN:
                    return True
    return False


class _Lines(HTMLParser):
    """Lines of a page from its stream of events: text, tags, characters in links, whether the line
    stands in a part that is no article, and the numbers of the nearest container around it and of the nearest
    article or main element (0: none). ``parent`` leads from a container to the one around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.names: Counter = Counter()
        self.boxes: list[int] = [0]
        self.articles: list[int] = [0]
        self.parent = [0]
        self.aside = self.links = 0
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, bool, int, int]] = []

    def parse_marked_section(self, i, report=1):
        """A marked section has no meaning in a page: it is a comment up to the next bracket, whatever it holds."""
        return self.parse_bogus_comment(i, report)

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.aside > 0, self.boxes[-1], self.articles[-1]))
            self.tags = 0
        self.text, self.linked = [], 0

    def _pop(self, tag: str, aside: bool) -> None:
        if tag in _BLOCK or aside:
            self._end_line()
        self.aside -= aside
        self.links -= tag == "a"
        self.names[tag] -= 1
        if tag in _BOX:
            self.boxes.pop()
        if tag in ("article", "main"):
            self.articles.pop()

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._end_line()
        if tag in _CLOSES_P or tag == "p":
            self._close("p", up_to=_CLOSES_P - {"p"})
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            self._close(tag, up_to=frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        if tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        marked = tag in _ASIDE or _marked(tag, attrs)
        if marked:
            self._end_line()
        self.open.append((tag, marked))
        self.aside += marked
        self.links += tag == "a"
        self.names[tag] += 1
        if tag in _BOX:
            self.parent.append(self.boxes[-1])
            self.boxes.append(len(self.parent) - 1)
        if tag in ("article", "main"):
            self.articles.append(self.boxes[-1])

    def _close(self, tag: str, up_to: frozenset = frozenset()) -> None:
        """Ends the nearest open element of that name and all within it, unless one of ``up_to``
        stands between."""
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop(*self.open.pop())
                return
            if self.open[k][0] in up_to:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag == "p" and not self.names["p"]:
            self._end_line()
        else:
            self._close(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(tag)

    def handle_data(self, data):
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def finish(self) -> list[tuple]:
        self.close()
        self._end_line()
        return self.lines


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    weight = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(x, weight, "same") / np.convolve(np.ones(len(x)), weight, "same") if len(x) > 2 * reach else (
        np.array([(x * (w := np.exp(-((np.arange(len(x)) - k) ** 2) / (2 * sigma**2)))).sum() / w.sum() for k in range(len(x))])
    )


def _threshold(x: np.ndarray) -> float:
    """Border of two clusters of values: the cut with the greatest variance between them."""
    x = np.sort(x)
    n = np.arange(1, len(x))
    left = np.cumsum(x)[:-1]
    between = n * (len(x) - n) * (left / n - (x.sum() - left) / (len(x) - n)) ** 2
    return float(x[:-1][np.argmax(between)]) if len(n) and between.max() > 0 else 0.0


def content_lines(lines: list[tuple], parent: list[int], sigma: float = 1.0) -> np.ndarray:
    """Which lines belong to content regions.

    Ratios of characters outside links per tag are smoothed, over each stretch between parts that are no article,
    and cut into two clusters: the upper lines are content. They choose the regions: article and main elements
    that hold one and are not links for the most part; on pages without such, the nearest containers of several lines in which they have most of the
    characters, beside the upper lines themselves. A region keeps all its lines but those of parts that are no article; outside
    an article element a line that stands wholly in a link goes.
    """
    aside = np.array([x[3] for x in lines], bool)
    size, linked = np.array([len(x[0]) for x in lines]), np.array([x[2] for x in lines])
    ratio = np.where(aside, 0.0, np.maximum(size - linked, 0) / np.maximum([x[1] for x in lines], 1))
    score = np.zeros(len(lines))
    # Smoothing runs over each region between parts that are no article, so these neither lend nor borrow.
    cut = np.flatnonzero(np.diff(np.concatenate([[True], aside, [True]]).astype(int)))
    for lo, hi in zip(cut[::2], cut[1::2], strict=True):
        score[lo:hi] = _smooth(ratio[lo:hi], sigma)
    score = np.log1p(score)
    upper = (score > _threshold(score)) & ~aside
    article = np.array([x[5] for x in lines])
    # Its own text must speak for an article, not only its neighbours' ratios.
    own, links, seen = (np.bincount(article, v, len(parent)) for v in (np.where(aside, 0, size - linked), np.where(aside, 0, linked), upper * (size - linked)))
    chosen = set(np.flatnonzero((seen > 0) & (own >= links)).tolist()) - {0}
    if chosen:
        return ~aside & np.isin(article, list(chosen))
    box = np.array([x[4] for x in lines])
    held, above, many = (np.bincount(box, np.where(aside, 0, x), len(parent)) for x in (size, size * upper, np.ones(len(lines))))
    for inner in range(len(parent) - 1, 0, -1):  # a container's number is greater than that of the one around it
        for x in (held, above, many):
            x[parent[inner]] += x[inner]
    region = np.zeros(len(parent), np.int64)
    for inner in range(1, len(parent)):
        region[inner] = inner if many[inner] > 1 else region[parent[inner]]
    most = 2 * above > held
    return ~aside & (upper | most[region[box]]) & (ratio > 0)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of one page, its blocks joined by line feeds; empty if there is none."""
    parser = _Lines()
    parser.feed(html or "")
    lines = parser.finish()
    keep = content_lines(lines, parser.parent, sigma) if lines else []
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("url"), pa.array(texts, pa.string())], ["k", "url", "text"])


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page from its whole HTML: ``key``, url, text.

    Parser events become lines, one per block. A line's ratio is its characters outside links per
    tag. Navigation, headers, footers, forms, adverts and reader comments, known by element or as containers whose class, id
    or role says nothing else, have no ratio. The ratios, smoothed by a Gaussian over neighbouring lines and cut into
    two clusters, select the content regions (``content_lines``), which are kept whole but for such parts.

    A null or empty page, and one without content, gives an empty text. Broken markup is read as far as
    events go; a marked section is a comment. A very long page is read whole, one at a time. Null and repeated keys keep
    their rows. An empty table gives no rows. Other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(_run, f"k {kind}, url string, text string")
    return out.withColumnRenamed("k", key).withColumnRenamed("url", url)
