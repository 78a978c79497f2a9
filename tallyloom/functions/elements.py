"""Elements of a page by number: an element's descendants are those numbered after it up to its last one, so what belongs
to a panel, a card or a section is found by intervals. Each element also knows its parent and the part of the page's text
that it spans; the text mass of any subtree is a difference of two running sums, taken in the one pass of the parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.markup import Markup
from tallyloom.functions.text import DASHES, FOLD_FROM, FOLD_TO, SPACES, ZERO_WIDTH

# Elements of HTML; those without content, whose text is no text, that open a line, that are headings.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg canvas".split())
CONTROLS = frozenset("button select option textarea".split())
LINES = frozenset("p div section article li tr br h1 h2 h3 h4 h5 h6 blockquote dt dd ul ol table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, and what keeps that open.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "thead", "tbody"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ({"p"}, {"div", "section", "article", "main", "td", "th", "li", "form", "button", "blockquote", "body", "table"})),
}

# Fixed values of page cleaning: parts that frame a page, the share of the body that makes such a part its content, marks of
# boilerplate in class or id, places of the main content and their least share, headings that are no titles.
FRAMES = ("nav", "footer", "header", "aside")
FRAME_SHARE, MAIN_SHARE = 0.4, 0.3
MARKS = re.compile("cookie|consent|kvkk|gdpr|cerez|çerez|breadcrumb|social-share|share-button|newsletter|popup|modal|back-to-top|skip-link|site-footer|site-header", re.I)
MAIN_TAGS, MAIN_IDS = frozenset({"main", "article"}), frozenset({"main-content", "content"})
MAIN_CLASSES = frozenset({"campaign-detail", "kampanya-detay", "content-detail", "page-content"})
NO_TITLES = ("kampanya koşul", "koşullar", "kampanya dışı", "sıkça sorulan", "nasıl katıl", "başvuru", "detaylar")
TEMPLATE = ("{{", "}}", "${")
SECTION_HEADS = HEADINGS | {"strong", "b", "dt"}
INLINE_HEADS = frozenset({"strong", "b", "dt", "span", "em"})
CLIMB = 3
#: Stands between cells until empty ones are gone; a sign that no text shows.
CELL = "\x1f"

_PLAIN = str.maketrans(dict.fromkeys(ZERO_WIDTH, "") | dict.fromkeys(SPACES, " ") | dict.fromkeys(DASHES, "-"))
_FOLD = str.maketrans(dict(zip(FOLD_FROM, FOLD_TO, strict=True)))


def plain(text: str) -> str:
    """Normalized text: no zero-width signs, plain blanks and dashes, one blank, at most one empty line."""
    import unicodedata

    text = unicodedata.normalize("NFKC", text.translate(_PLAIN)).translate(_PLAIN)
    lines = [" ".join(x for x in re.split(r"[ \t\f\v]+", line) if x) for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def lowered(text: str) -> str:
    return text.replace("İ", "i").replace("I", "ı").lower()


def folded(text: str) -> str:
    """Lower case and plain letters."""
    return lowered(text).translate(_FOLD)


#: The attributes of all elements that have none.
BARE: dict[str, str] = {}


class Tree(Markup):
    """The elements of a page in order of their start."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.last: list[int] = []  # number of the last descendant
        self.first_piece: list[int] = []
        self.end_piece: list[int] = []
        self.pieces: list[tuple[int, str]] = []  # element and text
        self.open: list[int] = []
        self.silent = 0
        self.feed(html)
        self.close()
        self._pop_to(0)

    def _pop_to(self, depth: int) -> None:
        for k in self.open[depth:]:
            self.last[k], self.end_piece[k] = len(self.tag) - 1, len(self.pieces)
            self.silent -= self.tag[k] in SILENT
        del self.open[depth:]

    def _end_before(self, ended: set[str], keep: set[str]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[depth]]
            if name in keep:
                break
            if name in ended:
                self._pop_to(depth)
                break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS and self.open and self.tag[self.open[-1]] not in ENDS[tag][1]:
            self._end_before(*ENDS[tag])
        k, at = len(self.tag), len(self.pieces)
        self.tag.append(tag)
        self.attrs.append({n: v or "" for n, v in reversed(attrs)} if attrs else BARE)
        self.parent.append(self.open[-1] if self.open else -1)
        self.last.append(k)
        self.first_piece.append(at)
        self.end_piece.append(at)
        if tag not in EMPTY:
            self.open.append(k)
            if tag in SILENT:
                self.silent += 1

    def handle_leaf(self, tag: str, attrs: list, text: str) -> None:
        if tag in EMPTY or tag in SILENT:
            return super().handle_leaf(tag, attrs, text)
        if tag in ENDS and self.open and self.tag[self.open[-1]] not in ENDS[tag][1]:
            self._end_before(*ENDS[tag])
        k, at = len(self.tag), len(self.pieces)
        self.tag.append(tag)
        self.attrs.append({n: v or "" for n, v in reversed(attrs)} if attrs else BARE)
        self.parent.append(self.open[-1] if self.open else -1)
        self.last.append(k)
        self.first_piece.append(at)
        if text and not self.silent:
            self.pieces.append((k, text))
            at += 1
        self.end_piece.append(at)

    def handle_leaves(self, tag: str, texts: list[str]) -> None:
        around = self.open[-1] if self.open else -1
        ends_nothing = tag not in ENDS or (around >= 0 and self.tag[around] in ENDS[tag][1])
        if self.silent or tag in EMPTY or tag in SILENT or not ends_nothing or not all(texts):
            return super().handle_leaves(tag, texts)
        k, at, n = len(self.tag), len(self.pieces), len(texts)
        own = range(k, k + n)
        self.tag += [tag] * n
        self.attrs += [BARE] * n
        self.parent += [around] * n
        self.last += own
        self.first_piece += range(at, at + n)
        self.end_piece += range(at + 1, at + n + 1)
        self.pieces += zip(own, texts, strict=True)

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.tag[k := self.open[-1]] == tag:  # the usual case
            self.open.pop()
            self.last[k], self.end_piece[k] = len(self.tag) - 1, len(self.pieces)
            if tag in SILENT:
                self.silent -= 1
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[depth]] == tag:
                self._pop_to(depth)
                break
            if tag in ("b", "i", "a", "span", "em", "strong", "p") and self.tag[self.open[depth]] in ("td", "th", "table"):
                break  # a cell holds what was opened before it

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append((self.open[-1] if self.open else -1, data))

    def classes(self, k: int) -> list[str]:
        return self.attrs[k].get("class", "").split()

    def above(self, k: int) -> list[int]:
        """The elements around it, from its parent up."""
        out = []
        while (k := self.parent[k]) >= 0:
            out.append(k)
        return out

    def text(self, k: int, between: str = "") -> str:
        """The element's text on one line."""
        begin, end = self.first_piece[k], self.end_piece[k]
        whole = self.pieces[begin][1] if end - begin == 1 else between.join([t for _, t in self.pieces[begin:end]])
        return " ".join(whole.split())

    def masses(self, gone: list[bool]) -> list[int]:
        """Running sums over the pieces of the letters that are left; an element's mass is the difference at its ends."""
        sums = [0]
        for (_, t), out in zip(self.pieces, gone, strict=True):
            sums.append(sums[-1] + (0 if out else len(t.strip())))
        return sums

    def mass(self, sums: list[int], k: int) -> int:
        return sums[self.end_piece[k]] - sums[self.first_piece[k]]

    def noise(self) -> list[bool]:
        """Which pieces are none of the content: controls, marked boilerplate, and frames of at most FRAME_SHARE of the body."""
        gone = [False] * len(self.pieces)

        def drop(k: int) -> None:
            for i in range(self.first_piece[k], self.end_piece[k]):
                gone[i] = True

        every = range(len(self.tag))
        for k in every:
            if self.tag[k] in CONTROLS:
                drop(k)
        body = next((k for k in every if self.tag[k] == "body"), None)
        whole = self.mass(self.masses(gone), body) if body is not None else 0
        for frame in FRAMES:
            sums = self.masses(gone)
            for k in every:
                if self.tag[k] == frame and not (whole and self.mass(sums, k) > whole * FRAME_SHARE):
                    drop(k)
        for k in every:
            if MARKS.search(self.attrs[k].get("class", "")) or MARKS.search(self.attrs[k].get("id", "")):
                drop(k)
        return gone

    def main(self, sums: list[int]) -> tuple[int, int]:
        """The pieces of the main content: the heaviest of the places for it, the body if none has MAIN_SHARE of its text."""
        every = range(len(self.tag))
        body = next((k for k in every if self.tag[k] == "body"), None)
        span = (self.first_piece[body], self.end_piece[body]) if body is not None else (0, len(self.pieces))
        places = [k for k in every if self.tag[k] in MAIN_TAGS or self.attrs[k].get("role") == "main" or self.attrs[k].get("id") in MAIN_IDS or MAIN_CLASSES.intersection(self.classes(k))]
        best = max(places, key=lambda k: (self.mass(sums, k), -k), default=None)
        if best is None or not self.mass(sums, best) or self.mass(sums, best) < (sums[span[1]] - sums[span[0]]) * MAIN_SHARE:
            return span
        return self.first_piece[best], self.end_piece[best]

    def lines(self, spans: list[tuple[int, int]], gone: list[bool], ends: dict[int, str] | None = None) -> str:
        """Pieces of text with a line's end after every block, table rows with bars between their cells."""
        ends = self.breaks() if ends is None else ends
        out = []
        for begin, end in spans:
            for i in range(begin, end + 1):
                if i > begin and i in ends:
                    out.append(ends[i])
                if i < end and not gone[i]:
                    out.append(self.pieces[i][1].replace("\n", " "))
            out.append("\n")
        rows = re.sub(rf"{CELL}(?: *{CELL})+", CELL, " ".join(out))
        return plain(re.sub(rf"(\n *){CELL}", r"\1", re.sub(rf"{CELL}( *\n)", r"\1", rows)).replace(CELL, "|"))

    def breaks(self) -> dict[int, str]:
        """What stands before the piece of a number: a line's end where a block ended, a bar where a cell did."""
        out: dict[int, str] = {}
        for k, tag in enumerate(self.tag):
            if tag in LINES or tag in ("td", "th"):
                at = self.end_piece[k]
                sign = CELL if tag in ("td", "th") else "\n"
                out[at] = "\n" if "\n" in (sign, out.get(at)) else CELL
            if tag == "table":
                out[self.first_piece[k]] = "\n"
        return out

    def title(self, ignore: frozenset[str] = frozenset()) -> str:
        """The first usable heading of first rank, else of second, else what the page is shared as, else its title."""
        usable = lambda t: len(t) >= 3 and not any(x in t for x in TEMPLATE) and not re.search(r"[\"']\s*\+|\+\s*[\"']", t) and not any(x in lowered(t) for x in NO_TITLES) and folded(t) not in ignore
        spaced = lambda k: " ".join(plain(" ".join(t for _, t in self.pieces[self.first_piece[k] : self.end_piece[k]])).split())
        for rank in ("h1", "h2"):
            for k, tag in enumerate(self.tag):
                if tag == rank and usable(text := spaced(k)):
                    return text
        for k, tag in enumerate(self.tag):
            if tag == "meta" and self.attrs[k].get("property") == "og:title" and (text := plain(self.attrs[k].get("content", ""))):
                return text
        return next((spaced(k) for k, tag in enumerate(self.tag) if tag == "title"), "")

    def sections(self, keywords: list[str] | None = None) -> Iterator[tuple[str, str]]:
        """Heading and text of each section: what follows beside the heading, up to the next one. A heading inside a line that
        has nothing beside it stands for the block it is in, up to CLIMB levels. With keywords, only sections whose heading
        holds one."""
        gone, ends = self.noise(), self.breaks()
        beside: dict[int, list[int]] = {}
        for k, p in enumerate(self.parent):
            beside.setdefault(p, []).append(k)
        place = {k: i for group in beside.values() for i, k in enumerate(group)}
        after = lambda k: beside[self.parent[k]][place[k] + 1 :]
        for k, tag in enumerate(self.tag):
            if tag not in (SECTION_HEADS if keywords else HEADINGS):
                continue
            heading = " ".join(plain(" ".join(t for i, (_, t) in enumerate(self.pieces[self.first_piece[k] : self.end_piece[k]], self.first_piece[k]) if not gone[i])).split())
            if keywords and not any(x in lowered(heading) for x in keywords):
                continue
            node = k
            if tag in INLINE_HEADS:
                for _ in range(CLIMB):
                    up = self.parent[node]
                    if place[node] + 1 < len(beside[up]) or up < 0 or self.tag[up] in ("body", "html"):
                        break
                    node = up
            spans = []
            for s in after(node):
                if self.tag[s] in HEADINGS:
                    break
                spans.append((self.first_piece[s], self.end_piece[s]))
            yield heading, self.lines(spans, gone, ends)


PARTS = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


@F.pandas_udf(PARTS)
def page_parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """struct<title, text> of an html column: the best heading and the clean text of the main content; empty for null."""
    for column in batches:
        titles, texts = [], []
        for html in column:
            tree = Tree(html or "")
            gone = tree.noise()
            titles.append(tree.title())
            texts.append(tree.lines([tree.main(tree.masses(gone))], gone))
        yield pd.DataFrame({"title": titles, "text": texts})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())])))
def page_sections(column: pd.Series) -> pd.Series:
    """array<struct<heading, text>>: what follows each heading of a rank."""
    return pd.Series([[{"heading": h, "text": t} for h, t in Tree(html or "").sections()] for html in column], dtype="object")


def section_text(html: str, *keywords: str):
    """Text of the first section that has any and whose heading holds one of the keywords, else null."""
    words = [lowered(k) for k in keywords]

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([next((t for _, t in Tree(h or "").sections(words) if t), None) for h in column], dtype="object")

    return run(html)


#: Elements in a batch of rows at most, and one page's more.
BATCH = 20_000


def elements(pages: DataFrame, ident: str, html: str, texts: tuple[str, ...] = ("a", "button", "td", "th", "span", "h1", "h2", "h3"), short: int = 0, tags: tuple[str, ...] = (), paths: tuple[str, ...] = ("a", "button", "span", "tr"), named: bool = False) -> DataFrame:
    """A row per element: page id, pre (its number), last (that of its last descendant), parent, tag, element_id, classes,
    attrs, text for elements of the tags in `texts` and, with blanks between its pieces, for all others that have no more than
    `short` letters, above: the elements around it, from its parent up, for those of the tags in `paths` (only those with an id
    or a class if `named`), and cells: the texts of the td right below it, for a tr. With `tags`, only elements of these tags
    and those with an id or a class have rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        for batch in batches:
            for i, h in zip(batch.column(0), batch.column(1), strict=True):
                i, t = i.as_py(), Tree(h.as_py() or "")
                sums = [0]
                for _, piece in t.pieces:
                    sums.append(sums[-1] + len(piece))
                cells: dict[int, list[str]] = {k: [] for k, tag in enumerate(t.tag) if tag == "tr"}
                for k, tag in enumerate(t.tag if cells else ()):
                    if tag == "td" and t.parent[k] in cells:
                        cells[t.parent[k]].append(t.text(k))
                for k, tag in enumerate(t.tag):
                    own = t.attrs[k]
                    if tags and tag not in tags and "id" not in own and "class" not in own:
                        continue
                    text = t.text(k) if tag in texts else t.text(k, " ") if sums[t.end_piece[k]] - sums[t.first_piece[k]] <= short else None
                    row = i, k, t.last[k], t.parent[k], tag, own.get("id"), t.classes(k), list(own.items()) if own else [], text, [a for a in t.above(k) if not named or "id" in t.attrs[a] or "class" in t.attrs[a]] if tag in paths else None, cells.get(k)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) >= BATCH:
                    yield rows()
                    out = [[] for _ in schema]
        yield rows()

    schema = pa.schema([("id", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("element_id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("above", pa.list_(pa.int32())), ("cells", pa.list_(pa.string()))])
    base = pages.select(F.col(ident).cast("long").alias("id"), F.col(html).cast("string").alias("html"))
    return base.mapInArrow(run, "id long, pre int, last int, parent int, tag string, element_id string, classes array<string>, attrs map<string,string>, text string, above array<int>, cells array<string>").withColumnRenamed("id", ident)
