"""Products from fee panels and rows from listing cards: what belongs to what is read from the elements' intervals."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions.elements import BARE, BATCH, Tree, folded
from tallyloom.functions.text import ascii_fold, lower_tr, slugify
from tallyloom.sources.staged import staged

# What the tabs of a fee page stand for, how a row of a profit rate begins (folded), cells that it has
# at least.
TABS = {"İhtiyaç Finansmanı": "ihtiyac_finansmani", "Konut Finansmanı": "konut_finansmani", "Taşıt Finansmanı": "tasit_finansmani"}
RATE_ROW, ROW_CELLS = "kar oran", 6
#: The cells of such a row that are read.
ROW = {"fee": 0, "low": 2, "high": 4, "note": 5}


def by_number(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of both sides' elements by page and number. Elements have so many equal values that their files are tiny, which says
    nothing about their rows: they are sorted and merged, never broadcast."""
    return left.join(right.hint("merge"), on, how)


def _bracket(c: Column, word: str) -> Column:
    """Both numbers of "(1-60 ay vade)" as texts, if a bracket holds the word behind two numbers."""
    bracket = F.get(F.filter(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), 1), lambda b: lower_tr(b).rlike(rf"\d\s*{word}")), F.lit(0))
    numbers = F.regexp_extract_all(bracket, F.lit(r"\d[\d.,]*"), 0)
    return F.when(F.size(numbers) >= 2, F.slice(numbers, 1, 2))


def fee_rates(elements: DataFrame, ident: str, tabs: dict[str, str] = TABS, title_class: str = "custom-accordion__title") -> DataFrame:
    """A row per profit rate of a fee page: page id, panel (its number on the page, by tab and place), product_type, name,
    amount_min, amount_max, place (of the row), term_label, term_months, rate, evidence. A tab's link names its pane, a
    panel's button its body; a cell belongs to its row, a row to the body around it. Rows of fees and rows without any rate
    are left out; the lower rate counts if both are given. Pages join on their id only, each with its own elements."""
    is_link = (F.col("tag") == "a") & F.startswith(F.col("attrs")["href"], F.lit("#"))
    is_bar = (F.col("tag") == "ul") & F.array_contains("classes", "nav-pills")
    is_title = (F.col("tag") == "button") & F.array_contains("classes", title_class) & (F.trim("text") != "")
    is_rate = (F.col("tag") == "tr") & (F.size("cells") >= ROW_CELLS) & F.startswith(ascii_fold(lower_tr(F.trim(F.get("cells", F.lit(0))))), F.lit(RATE_ROW))
    part = F.when(is_link, "link").when(is_bar, "bar").when(is_title, "title").when(is_rate, "rate")
    told = elements.withColumn("part", part).filter(F.col("part").isNotNull() | F.col("element_id").isNotNull())
    e = staged(told.select(ident, "pre", "part", "element_id", F.when(F.col("part").isin("link", "title"), F.col("text")).alias("text"), F.when(F.col("part") != "bar", F.col("above")).alias("above"), "cells", F.col("attrs")["href"].alias("href"), F.col("attrs")["data-target"].alias("target")), "elements")  # read five times, parsed once
    kind = F.create_map(*[F.lit(x) for pair in tabs.items() for x in pair])
    links = e.filter("part = 'link'").select(ident, F.col("pre").alias("tab"), F.substring("href", 2, 2**31 - 1).alias("element_id"), kind[F.col("text")].alias("product_type"), "above").filter("product_type is not null")
    pills = e.filter("part = 'bar'").select(ident, F.col("pre").alias("around"))
    tab = by_number(links.withColumn("around", F.explode("above")), pills, [ident, "around"])
    # A later link to the same pane, or a later element of the same id, doesn't count.
    named = e.filter("element_id is not null").groupBy(ident, "element_id").agg(F.min("pre").alias("around"))
    panes = by_number(tab.groupBy(ident, "element_id").agg(F.min(F.struct("tab", "product_type")).alias("t")).select(ident, "element_id", "t.*"), named, [ident, "element_id"]).select(ident, "tab", "product_type", "around")
    buttons = e.filter("part = 'title'").select(ident, F.col("pre").alias("button"), F.col("text").alias("name"), F.regexp_replace(F.coalesce("target", F.lit("")), "^#", "").alias("element_id"), F.explode("above").alias("around"))
    panels = by_number(buttons, panes, [ident, "around"]).select(ident, "tab", "button", "product_type", "name", "element_id")
    numbered = Window.partitionBy(ident).orderBy("tab", "button")
    bodies = by_number(panels.withColumn("panel", F.rank().over(numbered).cast("long")), named, [ident, "element_id"])
    rows = e.filter("part = 'rate'").select(ident, "pre", *[F.get("cells", F.lit(at)).alias(name) for name, at in ROW.items()], F.explode("above").alias("around"))
    return _rates_of_rows(by_number(rows, bodies, [ident, "around"]), ident)


def _rates_of_rows(in_body: DataFrame, ident: str) -> DataFrame:
    """The rates of the rows of profit rates in the bodies of panels: page id, panel, product_type, name, pre and the
    cells of ROW."""
    fee, low, high, note = map(F.col, ROW)
    rate = lambda c: parse.decimal_tr(F.trim(F.replace(c, F.lit("%"), F.lit(""))))
    term, band = _bracket(fee, "ay"), _bracket(F.col("name"), "tl")
    out = in_body.withColumns({"rate": F.coalesce(rate(low), rate(high)), "term": term, "band": band}).filter("rate is not null")
    return out.select(
        ident, "panel", "product_type", "name", parse.decimal_tr(F.col("band")[0]).alias("amount_min"), parse.decimal_tr(F.col("band")[1]).alias("amount_max"), F.col("pre").alias("place"),
        F.when(F.col("term").isNotNull(), F.concat(F.col("term")[0], F.lit("-"), F.col("term")[1], F.lit(" ay vade"))).alias("term_label"), F.col("term")[1].cast("int").alias("term_months"), "rate",
        F.trim(F.concat(fee, F.lit(" — Asgari "), low, F.lit(", Azami "), high, F.lit(". "), note)).alias("evidence"),
    )


def panel_rows(t: Tree, tabs: dict[str, str], title_class: str) -> Iterator[tuple]:
    """Panel, product type, name, number and the cells of ROW of a page's rows of profit rates, as fee_rates says."""
    named: dict[str, int] = {}
    links, pills, buttons, cells = [], [], [], {}
    for k, tag in enumerate(t.tag):
        own = t.attrs[k]
        if own and "id" in own:
            named.setdefault(own["id"], k)
        if tag == "td":
            if (p := t.parent[k]) in cells:
                cells[p].append(k)
        elif tag == "tr":
            cells[k] = []
        elif own is BARE:
            continue
        elif tag == "a" and own.get("href", "").startswith("#"):
            links.append(k)
        elif tag == "ul" and "nav-pills" in t.classes(k):
            pills.append(k)
        elif tag == "button" and title_class in t.classes(k):
            buttons.append(k)
    panes: dict[str, tuple[int, str]] = {}  # the first link to a pane counts
    for k in links:
        ident, kind = t.attrs[k]["href"][1:], tabs.get(t.text(k))
        if kind is not None and ident in named and ident not in panes and any(p < k <= t.last[p] for p in pills):
            panes[ident] = k, kind
    places = [k for k, below in cells.items() if len(below) >= ROW_CELLS and folded(t.text(below[0])[: len(RATE_ROW)]) == RATE_ROW]
    within = lambda places, k: places[bisect_right(places, k) : bisect_right(places, t.last[k])]
    panel = 0
    for ident, (_, kind) in panes.items():
        for k in within(buttons, named[ident]):
            if name := t.text(k):
                panel += 1
                body = named.get(t.attrs[k].get("data-target", "").removeprefix("#"))
                for row in within(places, body) if body is not None else ():
                    yield panel, kind, name, row, *[t.text(cells[row][at]) for at in ROW.values()]


def page_fee_rates(pages: DataFrame, ident: str, html: str, tabs: dict[str, str] = TABS, title_class: str = "custom-accordion__title") -> DataFrame:
    """The rows of fee_rates for whole pages: what belongs to what is told where a page is parsed, from the intervals of its own
    elements, so that no elements are written, sorted or joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        for batch in batches:
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in panel_rows(Tree(h.as_py() or ""), tabs, title_class):
                    for column, value in zip(out, (i, *row), strict=True):
                        column.append(value)
                if len(out[0]) >= BATCH:
                    yield rows()
                    out = [[] for _ in schema]
        yield rows()

    schema = pa.schema([("id", pa.int64()), ("panel", pa.int64()), ("product_type", pa.string()), ("name", pa.string()), ("pre", pa.int32()), *[(c, pa.string()) for c in ROW]])
    base = pages.select(F.col(ident).cast("long").alias("id"), F.col(html).cast("string").alias("html"))
    return _rates_of_rows(base.mapInArrow(run, "id long, panel long, product_type string, name string, pre int, " + ", ".join(f"{c} string" for c in ROW)).withColumnRenamed("id", ident), ident)


def fee_products(rates: DataFrame, ident: str, slug: Column | None = None) -> DataFrame:
    """A product per panel with its rates in order. Its key has the page's slug, the panel's number and its name, so that it never
    meets a product of that name from another page."""
    key = F.concat_ws("-", slug if slug is not None else F.col(ident).cast("string"), F.col("panel").cast("string"), slugify(F.col("name")))
    rate = F.struct("place", "term_label", "term_months", "rate", "evidence")
    return rates.groupBy(ident, "panel", "product_type", "name", "amount_min", "amount_max").agg(F.transform(F.array_sort(F.collect_list(rate)), lambda x: x.dropFields("place")).alias("rates")).withColumn("key", key)


def cards(elements: DataFrame, ident: str, prefix: str, box_class: str, labels: dict[str, str], levels: int = 3) -> DataFrame:
    """A row per address of a listing's cards: page id, place, url, text and a column per label. A card's link begins with the
    prefix; its box is the nearest element around it of the class, else its parent; a label is the first span of its class in
    the box, or in one of the boxes around that, `levels` in all. The first link of an address counts. Every element knows those
    around it, so links meet boxes, and boxes the first span in them, by number."""
    words = F.array(*map(F.lit, labels.values())).cast("array<string>")
    is_link = (F.col("tag") == "a") & F.coalesce(F.startswith(F.col("attrs")["href"], F.lit(prefix)), F.lit(False))
    is_box, is_label = F.array_contains("classes", box_class), (F.col("tag") == "span") & F.arrays_overlap("classes", words)
    e = elements.filter(is_link | is_label | is_box if labels else is_link).select(ident, "pre", "classes", "text", "above", F.when(is_link, F.col("attrs")["href"]).alias("href"), is_box.alias("is_box"), is_label.alias("is_label"))
    own = F.min_by(F.struct("pre", "text", "above"), "pre")
    if not labels:
        return e.groupBy(ident, "href").agg(own.alias("l")).select(ident, F.col("l.pre").alias("place"), F.col("href").alias("url"), "l.text")
    e = staged(e, "elements")
    links = e.filter("href is not null").groupBy(ident, "href").agg(own.alias("l")).select(ident, "href", "l.*")
    boxes = e.filter("is_box").select(ident, F.col("pre").alias("box"))
    path = links.select(ident, "href", F.posexplode("above").alias("depth", "box"))
    nearest = by_number(path, boxes, [ident, "box"]).groupBy(ident, "href").agg(F.min("depth").alias("depth"))
    cards = by_number(links, nearest, [ident, "href"], "left")
    rings = cards.select(ident, "href", F.posexplode(F.slice("above", F.coalesce("depth", F.lit(0)) + 1, F.lit(levels))).alias("ring", "box"))
    at = {name: F.min(F.when(F.array_contains("classes", wanted), F.struct("pre", "text"))).alias(name) for name, wanted in labels.items()}
    first = e.filter("is_label").select(ident, "pre", "text", "classes", F.explode("above").alias("box")).groupBy(ident, "box").agg(*at.values())
    near = {name: F.min(F.when(F.col(name).isNotNull(), F.struct("ring", name)))[name]["text"].alias(name) for name in labels}
    found = by_number(rings, first, [ident, "box"]).groupBy(ident, "href").agg(*near.values())
    return by_number(links, found, [ident, "href"], "left").select(ident, F.col("pre").alias("place"), F.col("href").alias("url"), "text", *[F.nullif(F.trim(name), F.lit("")).alias(name) for name in labels])
