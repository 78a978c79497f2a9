"""Main text of web pages from the standard library's parser events.

The parser's events stream into lines, one per block element. Text inside boilerplate (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments), whether a block or an element within a line, is left out as it
arrives; a line knows its text, how many tags stand in it, its share of link text and its element. The text-to-tag ratio
of each line is smoothed with a Gaussian over its neighbours and a two-means threshold clusters the lines into content
and rest, on every page. Lines of an article or main element weigh more. Where most content lies in such elements, these
elements are the region; else it is the smallest element with four fifths of the content. In a region that is the page
itself, lines before the first and after the last content line stay if they are headings just above it or elements of
the same kind beside content; lines that are mostly links stay only as content, and small articles (teasers) don't.

Edge cases: null, empty and broken html give what text the parser finds, possibly none (empty text). A page without any
block is one line; with equal ratios in all lines all are content. Nesting of any depth and pages of any length are read
whole, in one pass without recursion. Repeated rows each get a row, an empty table gives an empty result, other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import as_text, small_batches, with_rows

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form script style head title noscript template iframe object svg math select button textarea menu dialog canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations widget widgets toolbar pagination pager alert skip".split()
)
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCKS - {"option"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are lines of what stands around them.
LEAVES = HEADINGS | frozenset("p li dt dd td th pre caption figcaption legend".split())
#: First words of a class that says something about the whole page: "has-sidebar" isn't one.
STATES = frozenset("has no with without is not".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str  # empty: a line of boilerplate
    tags: int
    links: int  # characters in links
    element: int
    article: int  # number of the outermost article or main, 0: none


class Lines(HTMLParser):
    """Collects the lines of a page and its block elements: their names and parents, 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names, self.parents = ["#page"], [0]
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, boilerplate, article, block
        self.blocks = [0]
        self.count: dict[str, int] = {}
        self.bad = self.good = self.articles = self.anchors = 0
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.left_out = False

    def line(self) -> None:
        if self.bad:
            if self.left_out:
                self.lines.append(Line("", 1, 0, 0, 0))
                self.left_out = False
            return
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.links, self.blocks[-1], self.articles if self.good else 0))
            self.parts = []
        self.tags = self.links = 0

    def pop(self) -> None:
        name, bad, good, block = self.open.pop()
        self.count[name] -= 1
        self.good -= good
        self.anchors -= name == "a"
        if bad:
            self.line()
            self.bad -= 1
        if block:
            self.line()
            self.blocks.pop()

    @staticmethod
    def marked(name: str, attrs: list[tuple[str, str | None]]) -> bool:
        if name in BOILERPLATE:
            return True
        if not attrs or name in ("html", "body", "main"):
            return False
        for key, value in attrs:
            value = value or ""
            if key in ("class", "id"):
                for label in value.split():
                    words = [w.lower() for w in _TOKENS.findall(label)]
                    # "comment-item" and "site-footer" tell what they are; of an article only the first word does.
                    if words and words[0] not in STATES and (words[0] in MARKS or words[-1] in MARKS and name != "article"):
                        return True
            elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            elif key == "style" and _HIDDEN.search(value.lower()):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self.line()
            while self.open and tag in ENDS.get(self.open[-1][0], ()):
                self.pop()
            if self.count.get("p") and tag in ENDS["p"]:  # an unclosed inline element stands between
                self.shut("p")
        elif tag == "br" and not self.bad:
            self.parts.append("\n")
        self.tags += 1
        if tag not in VOID:
            bad, good = self.marked(tag, attrs), tag in ("article", "main")
            if block and not self.bad:
                self.names.append(tag)
                self.parents.append(self.blocks[-1])
                self.blocks.append(len(self.names) - 1)
            else:
                block = False
            self.open.append((tag, bad, good, block))
            self.count[tag] = self.count.get(tag, 0) + 1
            self.bad += bad
            self.articles += good and not self.good
            self.good += good
            self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def shut(self, tag: str) -> None:
        while self.open and self.open[-1][0] != tag:
            self.pop()
        if self.open:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.line()
        self.tags += 1
        if self.count.get(tag):
            self.shut(tag)

    def handle_data(self, data: str) -> None:
        if self.bad:
            self.left_out = self.left_out or not data.isspace()
        else:
            self.parts.append(data)
            if self.anchors:
                self.links += len(data)

    def end(self) -> list[Line]:
        self.close()
        self.line()
        while self.open:
            self.pop()
        self.line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, mode="full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, mode="full")[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters (two-means on a line)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above) or (below.mean(), above.mean()) == (low, high):
            break
        low, high = float(below.mean()), float(above.mean())
    return (low + high) / 2


#: How much more the ratio of a line in an article or main element counts.
ARTICLE_WEIGHT = 1.5


#: Share of the content that the region's element must hold.
REGION_SHARE = 0.8


def region(page: Lines, content: np.ndarray) -> int:
    """The smallest block element with REGION_SHARE of the characters of content; lines count for what they stand in."""
    mass = [0] * len(page.names)
    for line, is_content in zip(page.lines, content, strict=True):
        if is_content:
            mass[page.parents[line.element] if page.names[line.element] in LEAVES else line.element] += len(line.text)
    for e in range(len(mass) - 1, 0, -1):  # parents have smaller numbers
        mass[page.parents[e]] += mass[e]
    return max(e for e, m in enumerate(mass) if m >= REGION_SHARE * mass[0])


def main_text(html: str, sigma: float = 1.0) -> str:
    page = Lines()
    page.feed(html)
    lines = page.end()
    clean = np.array([bool(x.text) for x in lines], bool)
    if not clean.any():
        return ""
    article = np.array([x.article for x in lines])
    inside = article > 0
    ratios = np.log1p([len(x.text) / max(1, x.tags) for x in lines]) * np.where(inside, ARTICLE_WEIGHT, 1.0)
    smooth = smoothed(ratios, sigma)
    # A dense line at the edge of its region is content though its neighbours pull it down.
    dense = np.maximum(ratios, smooth) >= min(threshold(smooth[clean]), float(smooth[clean].max())) - 1e-9
    content = clean & dense
    mass = np.array([len(x.text) for x in lines]) * content
    known = np.isin(article, article[content])
    if mass[inside].sum() >= mass[~inside].sum():
        keep = clean & inside & known
    else:
        top = region(page, content)
        within = [False] * len(page.names)
        within[top] = True
        for e in range(top + 1, len(within)):
            within[e] = within[page.parents[e]]
        linked = np.array([2 * x.links > len(x.text) for x in lines]) & ~content
        keep = clean & ~linked & (~inside | known) & np.array([within[x.element] for x in lines])
        at = np.arange(len(lines))
        first, last = np.flatnonzero(content & keep)[[0, -1]]
        if page.names[top] in ("#page", "html", "body"):
            kind = [(page.parents[x.element], page.names[x.element]) for x in lines]
            kinds = {kind[i] for i in np.flatnonzero(content & keep)}
            keep &= (at >= first) & (at <= last) | np.array([k in kinds for k in kind])
        first = np.flatnonzero(keep)[0]
        above = first
        while above and clean[above - 1] and not linked[above - 1]:
            above -= 1
        heads = [i for i in range(above, first) if page.names[lines[i].element] in HEADINGS]
        if heads:
            keep[heads[0] : first] = True
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def rows_of(stream: Iterator[dict]) -> Iterator[tuple]:
    for row in stream:
        text = main_text(row["html"])
        yield row["page_id"], row["url"], text, len(text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, without a shuffle."""
    small_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), as_text("html").alias("html"))
    return base.mapInArrow(with_rows(rows_of, RESULT), "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
