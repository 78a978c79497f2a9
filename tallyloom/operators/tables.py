"""Typed rows from table cells: rate tables, band-by-term matrices, payment plans. Cells are
(page_id, table_no, row_no, col_no, text, caption), as functions.html.exploded gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import limits, parse
from tallyloom.functions.text import fold, kept
from tallyloom.sources.staged import staged

#: Header words (folded) of the columns of rate tables; fixed values.
ALIASES = (("term", r"vade|sure|ay\b"), ("fee", r"tahsis|masraf|ucret"), ("annual_cost", r"yillik"), ("monthly_cost", r"aylik maliyet"), ("amount", r"tutar|limit"), ("rate", r"kar pay|oran|getiri"))
KEY = ["page_id", "table_no"]


def column_kinds(cells: DataFrame) -> DataFrame:
    """page_id, table_no, col_no, kind from the first row of each table."""
    head, kind = fold(F.col("text")), None
    for name, pattern in ALIASES:
        kind = F.when(head.rlike(pattern), name) if kind is None else kind.when(head.rlike(pattern), name)
    return cells.filter("row_no = 0").select(*KEY, "col_no", kind.alias("kind")).filter("kind is not null")


def rate_rows(cells: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, lo_months, hi_months, rate, fee, annual_cost, rate_type, evidence. A cost column makes a
    financing rate; else the caption tells yield or split. Rows without a rate are dropped, a rate of 0 only for yields."""
    body = cells.filter("row_no > 0").join(column_kinds(cells), [*KEY, "col_no"])
    rows = body.groupBy(*KEY, "row_no").pivot("kind", [n for n, _ in ALIASES]).agg(F.first("text", ignorenulls=True))
    extra = body.groupBy(*KEY, "row_no").agg(F.max("caption").alias("caption"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]), " | ").alias("evidence"))
    number = lambda c: parse.decimal_tr(F.regexp_replace(F.col(c), r"[^0-9.,]", ""))
    months = parse.term_months(F.col("term"))
    caption = fold(F.coalesce("caption", F.lit("")))
    kind = F.when(F.col("fee").isNotNull() | F.col("annual_cost").isNotNull() | F.col("monthly_cost").isNotNull(), "financing_rate").when(caption.rlike("getiri|katilma hesab"), "participation_yield").when(caption.rlike("paylasim"), "profit_sharing_ratio").otherwise("financing_rate")
    out = rows.join(extra, [*KEY, "row_no"]).select(*KEY, "row_no", months["lo"].alias("lo_months"), months["hi"].alias("hi_months"), number("rate").alias("rate"), number("fee").alias("fee"), number("annual_cost").alias("annual_cost"), kind.alias("rate_type"), "evidence")
    return out.filter(F.col("rate").isNotNull() & ~((F.col("rate_type") == "participation_yield") & (F.col("rate") == 0)))


def unpivoted(cells: DataFrame, parse_value: Column | None = None) -> DataFrame:
    """A matrix as rows: page_id, table_no, band (first cell of the row), header (first cell of the column), value."""
    bands = cells.filter("row_no > 0 and col_no = 0").select(*KEY, "row_no", F.col("text").alias("band"))
    heads = cells.filter("row_no = 0 and col_no > 0").select(*KEY, "col_no", F.col("text").alias("header"))
    value = parse_value if parse_value is not None else parse.decimal_tr(F.regexp_replace("text", r"[^0-9.,]", ""))
    inner = cells.filter("row_no > 0 and col_no > 0").select(*KEY, "row_no", "col_no", value.alias("value"))
    return inner.join(bands, [*KEY, "row_no"]).join(heads, [*KEY, "col_no"]).filter("value is not null")


def ltv_rows(cells: DataFrame) -> DataFrame:
    """unpivoted with the value band as lo, hi."""
    m = unpivoted(cells)
    band = parse.money_range(F.col("band"))
    return m.select(*KEY, band["lo"].alias("lo"), band["hi"].alias("hi"), F.col("header").alias("class"), F.col("value").alias("ratio"))


def payment_plans(cells: DataFrame) -> DataFrame:
    """page_id, table_no, instalments, total of tables whose first cells count 1, 2, 3, ...; the total is the sum of the
    second column's numbers."""
    number = parse.decimal_tr(F.regexp_replace("text", r"[^0-9.,]", ""))
    rows = cells.filter("row_no > 0").groupBy(*KEY, "row_no").agg(F.max(F.when(F.col("col_no") == 0, F.col("text"))).alias("place"), F.max(F.when(F.col("col_no") == 1, number)).alias("pay"))
    counted = rows.filter(F.col("place").rlike(r"^\d+$"))
    return counted.groupBy(*KEY).agg(F.count(F.lit(1)).alias("instalments"), F.sum("pay").alias("total"), F.max(F.col("place").cast("int")).alias("last")).filter("instalments = last").drop("last")


# Folded names of currencies on tabs and in captions, levels that a tab bar may stand above a table, names on a tab
# bar at least and at most.
TAB_CURRENCIES = {"tl": "TRY", "try": "TRY", "usd": "USD", "dolar": "USD", "eur": "EUR", "euro": "EUR", "yau": "XAU", "xau": "XAU", "altin": "XAU", "yag": "XAG", "xag": "XAG", "gumus": "XAG"}
CAPTION_CURRENCIES = (("USD", "dolar|usd"), ("EUR", "euro|eur"), ("XAU", "altin|xau|gram"), ("XAG", "gumus|xag"))
LEVELS, TABS = 8, (2, 8)


def tab_currencies(elements: DataFrame, ident: str) -> DataFrame:
    """page id, table_no, currency of the tables that lie under a tab bar: an element before the parent of one that holds the
    table, whose words are all currencies; the table's holder has the place of its tab among its siblings. The nearest bar
    counts. elements need the text of short ones (functions.elements.elements with `short`)."""
    e = staged(elements.select(ident, "pre", "last", "parent", "tag", "text"), "elements")
    beside = Window.partitionBy(ident, "parent").orderBy("pre")  # the children of one element
    placed = e.withColumns({"place": F.row_number().over(beside) - 1, "bar": F.lag("text").over(beside)})
    words = F.filter(F.split(fold(F.coalesce("bar", F.lit(""))), r"[\s|/,]+"), lambda w: w != "")
    names = F.create_map(*[F.lit(x) for pair in TAB_CURRENCIES.items() for x in pair])
    codes = F.transform(words, lambda w: names[w])
    bars = placed.filter("bar is not null").select(ident, F.col("pre").alias("parent"), kept(codes, lambda c: F.size(c).between(*TABS) & F.forall(c, lambda x: x.isNotNull())).alias("codes"))
    held = placed.join(bars, [ident, "parent"]).select(ident, F.col("pre").alias("from"), F.col("last").alias("to"), F.get("codes", F.col("place")).alias("currency")).filter("currency is not null")
    every = e.filter("tag = 'table'")
    outer = every.select(F.col(ident).alias("_id"), F.col("pre").alias("_pre"), F.col("last").alias("_last"))
    top = every.join(outer, (F.col(ident) == F.col("_id")) & (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_last")), "left_anti")
    tables = top.withColumn("table_no", F.row_number().over(Window.partitionBy(ident).orderBy("pre")) - 1)
    met = tables.join(held, ident).filter((F.col("from") <= F.col("pre")) & (F.col("pre") <= F.col("to")))
    return met.groupBy(ident, "table_no").agg(F.max_by("currency", "from").alias("currency"))


def matrix_rates(cells: DataFrame, currencies: DataFrame | None = None) -> DataFrame:
    """page_id, table_no, lo, hi, term_months, term_days_min, currency, rate of matrices of terms (columns) by amounts (rows): tables
    with two heads or more that name a term. The currency is that of the caption and heads, else of the tab (from
    `currencies`: page_id, table_no, currency), else lira; rows of grams are gold. Rows of withholding are left out."""
    known = cells.filter("row_no = 0 and col_no > 0").select(*KEY, "col_no", kept(limits.term_header(F.col("text")), lambda t: t["months"].isNotNull() | t["days_min"].isNotNull()).alias("term"))
    said = cells.filter("row_no = 0").groupBy(*KEY).agg(fold(F.concat_ws(" ", F.max("caption"), F.array_join(F.collect_list("text"), " "))).alias("_said"))
    matrices = known.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").join(said, KEY)
    of_caption = None
    for code, shape in CAPTION_CURRENCIES:
        of_caption = F.when(F.col("_said").rlike(shape), code) if of_caption is None else of_caption.when(F.col("_said").rlike(shape), code)
    matrices = matrices.join(currencies.withColumnRenamed("currency", "_tab"), KEY, "left") if currencies is not None else matrices.withColumn("_tab", F.lit(None).cast("string"))
    matrices = matrices.select(*KEY, F.coalesce(of_caption, F.col("_tab"), F.lit("TRY")).alias("currency"))
    bands = cells.filter("row_no > 0 and col_no = 0").select(*KEY, "row_no", F.col("text").alias("band")).filter(~fold(F.col("band")).contains("stopaj"))
    bands = bands.withColumns({"amount": limits.value_band(F.col("band")), "grams": fold(F.col("band")).rlike(r"\bgr(am)?\b")})
    value = parse.decimal_tr(F.regexp_replace("text", r"[^0-9.,]", ""))
    rates = cells.filter("row_no > 0 and col_no > 0").select(*KEY, "row_no", "col_no", kept(value, lambda v: v.isNotNull()).alias("rate"))
    out = rates.join(known.select(*KEY, "col_no", "term"), [*KEY, "col_no"]).join(bands, [*KEY, "row_no"]).join(matrices, KEY)
    return out.select(*KEY, F.col("amount.lo").alias("lo"), F.col("amount.hi").alias("hi"), F.col("term.months").alias("term_months"), F.col("term.days_min").alias("term_days_min"), F.when(F.col("grams"), "XAU").otherwise(F.col("currency")).alias("currency"), "rate")
