"""The campaign period of a free text, by which lines stand near which dates.

A text's lines are rows; whether a line has a date, a period word or a publication word are columns of them, and blocks
of date lines are islands between the other lines. So the search is a few window functions per text, not a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions.text import ascii_fold, lower_tr
from tallyloom.sources.staged import staged

# Words of lines that tell a period, and of lines that tell when the page was published; folded.
PERIOD_WORDS = (
    "tarihleri arasinda", "tarihleri arasi", "tarih araliginda", "tarihine kadar", "tarihinde sona er", "kampanya donemi", "kampanya tarihleri", "kampanya baslangic", "baslangic ve bitis", "son gun", "sona erecektir",
    "devam edecektir", "gecerlilik suresi", "gecerlilik tarihi", "bitis tarihi", "baslangic tarihi", "arasinda gecerli", "kadar gecerli", "tarihlerinde",
)
PUBLICATION_WORDS = ("yayin tarihi", "yayinlanma", "yayimlanma", "yayin baslangic", "guncelleme tarihi", "son guncelleme", "eklenme tarihi", "paylasim tarihi", "olusturulma", "duyuru tarihi")
DATE_HINT = rf"\d{{1,2}}\s*[./-]\s*\d{{1,2}}\s*[./-]\s*\d{{2,4}}|\d{{1,2}}\s+(?:{'|'.join(parse.MONTHS)})(?:\s+\d{{4}})?"
SEPARATOR = r"^[\s\-–—/|:.]*$|^(?:ile|ve|arasi|tarihleri)$"
LABEL_CHARS, BLOCK_LINES, STRUCTURED_CHARS = 80, 5, 200
STRENGTH = ("unknown", "partial", "inferred", "exact")


def _any(c, words):
    return c.rlike("|".join(words))


def period_lines(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, n (line number), line, folded, and what the line is: blank, dated, marked, published, pure (nothing but dates
    and separators), part (of a block of dates), island (the number of other lines up to here)."""
    rows = docs.select(F.col(ident), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    rows = rows.withColumn("folded", ascii_fold(lower_tr(F.trim(F.col("line"), F.lit(" \t\r")))))
    low = F.col("folded")
    rows = rows.withColumns({"blank": low == "", "dated": low.rlike(DATE_HINT), "marked": _any(low, PERIOD_WORDS), "published": _any(low, PUBLICATION_WORDS), "pure": low.rlike(DATE_HINT) & F.regexp_replace(low, DATE_HINT, "").rlike(SEPARATOR)})
    rows = rows.withColumn("part", ~F.col("published") & (F.col("dated") | low.rlike(SEPARATOR)))
    return rows.withColumn("island", F.sum((~F.col("part")).cast("int")).over(Window.partitionBy(ident).orderBy("n")))


def _blocks(rows: DataFrame, ident: str, before: bool) -> DataFrame:
    """ident, island, block: at most BLOCK_LINES lines next to the island's first line (or, `before`, to the one that ends it),
    up to a blank line, if one of them has a date."""
    order = Window.partitionBy(ident, "island").orderBy(F.col("n").desc() if before else F.col("n"))
    inside = rows.filter("part")
    filled = F.sum((~F.col("blank")).cast("int")).over(order)
    inside = inside.withColumn("filled", filled).filter("filled > 0")
    gaps = F.sum(F.col("blank").cast("int")).over(order)
    inside = inside.withColumn("gaps", gaps).filter("gaps = 0 and filled <= " + str(BLOCK_LINES))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return inside.groupBy(ident, "island").agg(text.alias("block"), F.max("dated").alias("_has")).filter("_has").drop("_has")


def campaign_period(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, start, end, precision, evidence of every text. In this order: a short label with its dates in the lines below
    (the first one ends the search); the surest of the marked lines and of dates above a marked line, the first among
    equals; a line of nothing but dates. Lines about publication never count. Unknown if nothing is found."""
    # What tells nothing and belongs to no block goes at once, the rest is written, so that each line is looked at once.
    rows = period_lines(docs, ident, text).withColumn("brief", F.length("folded") <= LABEL_CHARS)
    # A range without letters has two dates of three numbers each: a single date alone would only be found to be unknown.
    rows = rows.withColumn("ranged", F.col("pure") & (F.col("folded").rlike(r"\p{L}") | (F.regexp_count("folded", F.lit(r"\d+")) >= 6)))
    rows = staged(rows.filter("part or marked or ranged").drop("folded", "pure"), "lines")
    after = _blocks(rows, ident, False)
    above = _blocks(rows, ident, True).withColumn("island", F.col("island") + 1)
    usable = rows.filter(~F.col("blank") & ~F.col("published"))
    label = F.col("marked") & ~F.col("dated") & F.col("brief")
    found = [
        usable.filter(label).join(after, [ident, "island"]).select(ident, "n", F.lit(3).alias("rule"), F.col("block").alias("said"), F.col("block").alias("evidence")),
        usable.filter(F.col("marked") & ~F.col("dated")).join(above, [ident, "island"]).select(ident, "n", F.lit(2).alias("rule"), F.concat_ws(" ", "block", "line").alias("said"), F.col("block").alias("evidence")),
        usable.filter("marked and dated").select(ident, "n", F.lit(2).alias("rule"), F.col("line").alias("said"), F.col("line").alias("evidence")),
        usable.filter("ranged").select(ident, "n", F.lit(1).alias("rule"), F.col("line").alias("said"), F.col("line").alias("evidence")),
    ]
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    said = parse.with_date_range(candidates, "said", "p")
    strength = F.array_position(F.array(*map(F.lit, STRENGTH)), F.col("p.precision"))
    # Unknown ones lose here and aren't filtered out: the optimizer would write all of the date's expressions into the filter.
    rank = F.struct((F.col("p.precision") != "unknown").alias("known"), "rule", F.when(F.col("rule") == 2, strength).otherwise(F.lit(0)).alias("s"), (-F.col("n")).alias("n"))
    spot = F.regexp_extract(F.col("evidence"), r"(?s)\d{1,2}[\s./-].*\d", 0)
    best = said.withColumn("evidence", F.trim(spot)).groupBy(ident).agg(F.max_by(F.struct("p", "evidence"), rank).alias("b"))
    every = docs.select(ident).distinct().join(best, ident, "left")
    return every.select(ident, F.col("b.p.start").alias("start"), F.col("b.p.end").alias("end"), F.coalesce("b.p.precision", F.lit("unknown")).alias("precision"), F.when(F.col("b.p.precision") != "unknown", F.nullif(F.col("b.evidence"), F.lit(""))).alias("evidence"))


def structured_period(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the period of a labelled field's text: the dates of its first paragraph, if that is short enough to be a
    field; else null."""
    head = F.trim(F.get(F.split(F.trim(F.col(text)), r"\n\s*\n"), F.lit(0)))
    made = parse.with_date_range(docs.withColumn("_head", F.when(F.length(head) <= STRUCTURED_CHARS, head)), "_head", out)
    return made.withColumn(out, F.when(F.col("_head").isNotNull(), F.col(out))).drop("_head")


def period_in_sources(docs: DataFrame, ident: str, structured: str, conditions: str, body: str) -> DataFrame:
    """ident, start, end, precision, source: the first source that tells a period, in order of trust. What was found without
    evidence is no more than inferred."""
    out = structured_period(docs.select(ident, structured), structured, "_structured").select(ident, "_structured")
    sure = F.when(F.col("evidence").isNull() & (F.col("precision") == "exact"), "inferred").otherwise(F.col("precision"))
    for name, column in (("_conditions", conditions), ("_body", body)):
        found = campaign_period(docs.select(ident, column), ident, column)
        out = out.join(found.select(ident, F.struct("start", "end", sure.alias("precision")).alias(name)), ident)
    known = [F.when(F.col(f"{c}.precision") != "unknown", F.struct(F.col(f"{c}.start"), F.col(f"{c}.end"), F.col(f"{c}.precision"), F.lit(c[1:]).alias("source"))) for c in ("_structured", "_conditions", "_body")]
    best = out.withColumn("p", F.coalesce(*known))
    return best.select(ident, "p.start", "p.end", F.coalesce("p.precision", F.lit("unknown")).alias("precision"), "p.source")
