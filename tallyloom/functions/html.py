"""Table cells and form controls of pages, by the standard library's parser in Arrow functions. What follows (rates, limits) is
relational over the cells; functions.elements has titles, clean texts, sections and the elements themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.markup import Markup

# Elements of HTML.
SKIPPED = frozenset("script style noscript template svg iframe nav header footer aside form button select".split())
BREAKS = frozenset("p div section article main li ul ol tr table h1 h2 h3 h4 h5 h6 br hr blockquote dt dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Page(Markup):
    """One pass over a page: title, headings, lines with the heading above them, cells, controls."""

    def __init__(self, html: str, ignore: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.ignore = ignore
        self.title = self.og = ""
        self.headings: list[str] = []
        self.lines: list[tuple[str, str]] = []  # heading above, text
        self.cells: list[tuple[int, int, int, str, str]] = []  # table, row, column, text, caption
        self.controls: list[tuple[str, str, str, str, str]] = []  # kind, name, least, most, options
        self.skip: list[str] = []
        self.open: list[str] = []
        self.buffer: list[str] = []
        self.cell: list[str] | None = None
        self.table = self.row = self.col = -1
        self.depth = 0
        self.select: list | None = None
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.lines.append((self.headings[-1] if self.headings else "", text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "meta" and a.get("property") == "og:title":
            self.og = a.get("content") or ""
        if tag == "input" and (a.get("type") or "text") in ("text", "number", "range", "radio", "checkbox"):
            self.controls.append((a.get("type") or "text", a.get("name") or a.get("id") or "", a.get("min") or "", a.get("max") or "", a.get("value") or ""))
        if tag == "select":
            self.select = [a.get("name") or a.get("id") or "", []]
        if tag in BREAKS:
            self.flush()
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.table, self.row = self.table + 1, -1
        elif tag == "tr" and self.depth == 1:
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th") and self.depth == 1:
            self.close_cell()
            self.col, self.cell = self.col + 1, []
        if tag not in EMPTY:
            self.open.append(tag)
            if tag in SKIPPED:
                self.skip.append(tag)

    def close_cell(self) -> None:
        if self.cell is not None:
            self.cells.append((self.table, max(self.row, 0), self.col, " ".join("".join(self.cell).split()), self.headings[-1] if self.headings else ""))
            self.cell = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table" and self.depth:
            self.depth -= 1
        if tag == "select" and self.select:
            self.controls.append(("select", self.select[0], "", "", "|".join(self.select[1])))
            self.select = None
        if tag in HEADINGS and self.buffer and not self.skip:
            text = " ".join("".join(self.buffer).split())
            if text and text.casefold() not in self.ignore:
                self.headings.append(text)
        if tag in BREAKS:
            self.flush()
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                if last in SKIPPED and self.skip:
                    self.skip.pop()
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        where = self.open[-1] if self.open else ""
        if where == "title":
            self.title += data
        elif where == "option" and self.select is not None:
            self.select[1].append(" ".join(data.split()))
        elif not self.skip:
            if self.cell is not None:
                self.cell.append(data)
            elif where != "head":
                self.buffer.append(data)

    def best_title(self) -> str:
        return " ".join((self.headings[0] if self.headings else self.og or self.title).split())


def exploded(pages: DataFrame, ident: str, html: str, what: str) -> DataFrame:
    """A row per table cell (`what` = cells: table_no, row_no, col_no, text, caption) or per form control (controls: kind,
    name, least, most, options), with the page's id."""
    names = {"cells": ("table_no int", "row_no int", "col_no int", "text string", "caption string"), "controls": ("kind string", "name string", "least string", "most string", "options string")}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in getattr(Page(h or ""), what)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (1 + len(names))
            kinds = [pa.int64()] + [pa.int32() if n.endswith(" int") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["id", *[n.split()[0] for n in names]])

    base = pages.select(F.col(ident).cast("long").alias("id"), F.col(html).alias("html"))
    return base.mapInArrow(run, "id long, " + ", ".join(names)).withColumnRenamed("id", ident)


#: Patterns of pages that say "not found" with status 200; fixed values.
SOFT_404 = r"(?i)sayfa bulunamad|aradığınız sayfa|page not found|404 not found|içerik bulunamad"


def soft_404(title, text):
    """Why a page is a soft 404 (empty, title, body), or null."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(title.rlike(SOFT_404), "title").when(F.substring(text, 1, 2000).rlike(SOFT_404), "body")


def sentences_with(text, pattern: str):
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(pattern))
