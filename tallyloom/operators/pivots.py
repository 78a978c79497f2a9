"""Values by bank and cell (term and currency) from several sources that may disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currencies that come first in a row, the difference up to which two sources nearly agree, the mark of a note.
CURRENCIES, NEAR, NOTE = ("TRY", "USD", "EUR"), 0.5, "anomali"


def cell_order(currency: Column, term: Column) -> Column:
    """The order of a pivot's columns: by currency (TRY, USD, EUR, then others by name), then by term."""
    place = reduce(lambda out, x: out.when(currency == x[1], F.lit(x[0])), enumerate(CURRENCIES), F.when(currency.isNull(), F.lit(len(CURRENCIES) + 1))).otherwise(F.lit(len(CURRENCIES)))
    return F.struct(place.alias("place"), currency.alias("currency"), term.alias("term"))


def agreement(a: Column, b: Column) -> Column:
    """equal, near or different; null if one is missing."""
    return F.when(a.isNull() | b.isNull(), None).when(a == b, "equal").when(F.abs(a - b) <= NEAR, "near").otherwise("different")


def source_pivot(rates: DataFrame, bank: str, source: str, term: str, label: dict, currency: str, value: str, order: list[str], primary: str, evidence: str | None = None) -> DataFrame:
    """A row per bank: data_source, cells (array of struct<cell, value> in the order of columns), shared (first cell that both
    sources have), own and other value there, match, notes. In a cell the last value in `order` counts, kept as it comes by an
    aggregate. A bank's source is the primary one if it has any cell from there. Terms without a label are no cells, rows
    without a value give none. Only the two sources' cells of one bank meet in a row."""
    names = F.create_map(*[F.lit(x) for pair in label.items() for x in pair])
    known = rates.withColumn("_label", names[F.col(term)]).filter(F.col("_label").isNotNull() & F.col(value).isNotNull())
    cell = F.concat_ws("|", "_label", currency)
    note = F.when(F.contains(F.lower(evidence), F.lit(NOTE)), F.concat(cell, F.lit(": "), F.col(evidence))) if evidence else F.lit(None).cast("string")
    placed = known.select(F.col(bank).alias("bank"), (F.col(source) == primary).alias("first"), F.col(source).alias("source"), cell.alias("cell"), cell_order(F.col(currency), F.col(term)).alias("at"), F.col(value).alias("value"), F.struct(*order).alias("when"), note.alias("note"))
    last = placed.groupBy("bank", "first", "cell", "at").agg(F.max_by("value", "when").alias("value"), F.max_by("source", "when").alias("source"), F.collect_set("note").alias("notes"))
    both = last.groupBy("bank", "cell", "at").agg(F.max(F.when(F.col("first"), F.col("value"))).alias("own"), F.max(F.when(~F.col("first"), F.col("value"))).alias("other"), F.flatten(F.collect_list("notes")).alias("notes"))
    row = F.array_sort(F.collect_list(F.struct("at", "cell", "own", "other")))
    banks = both.groupBy("bank").agg(row.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("notes")))).alias("notes"), F.coalesce(F.bool_or(F.col("own").isNotNull()), F.lit(False)).alias("led"))
    shared = F.get(F.filter("r", lambda x: x["own"].isNotNull() & x["other"].isNotNull()), F.lit(0))
    mine = lambda x: F.when(F.col("led"), x["own"]).otherwise(x["other"])
    cells = F.transform(F.filter("r", lambda x: mine(x).isNotNull()), lambda x: F.struct(x["cell"].alias("cell"), mine(x).alias("value")))
    return banks.withColumn("s", shared).select("bank", F.when(F.col("led"), primary).otherwise("other").alias("data_source"), cells.alias("cells"), F.col("s.cell").alias("shared"), F.col("s.own").alias("own"), F.col("s.other").alias("other"), agreement(F.col("s.own"), F.col("s.other")).alias("match"), "notes")


def not_offered(products: DataFrame, bank: str, status: str) -> DataFrame:
    """Banks that say of a product that they don't offer it."""
    return products.filter(F.col(status) == "not_offered").select(bank).distinct()
