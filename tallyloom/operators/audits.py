"""Audits of facts, evidence and exports. Each is a few flags and one pre-aggregated count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import match_text

# What makes a text hard to annotate.
TIER = r"(?i)\d[\d.,]*\s*(?:TL|₺)?\s*(?:ve\s*)?(?:üzeri|üzerine|üzerindeki)"
TIMED = r"(?i)saat\s*\d{1,2}[.:]\d{2}"
PERCENT, AMOUNT = r"%\s*\d+(?:[.,]\d+)?", r"(?i)\d[\d.,]*\s*(?:TL|₺)"
INDIRECT = ("özel oranlı", "avantajlı", "düşük maliyetli")
SHORT_TEXT = 300


def coverage(units: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """units with the number of rows that each table has for them, 0 where it has none."""
    counts = [df.groupBy(key).agg(F.count(F.lit(1)).alias(name)) for name, df in tables.items()]
    out = reduce(lambda a, b: a.join(b, key, "left"), counts, units.select(key))
    return out.na.fill(0, list(tables))


def evidence_flags(facts: DataFrame, key: str, field: str, evidence: str, source: str, least: int = 12, most: int = 300) -> DataFrame:
    """A row per key: its facts, those without evidence, with too short or too long evidence, with evidence that isn't in
    the source, and whether all of several fields point to the same evidence."""
    e = F.trim(F.coalesce(F.col(evidence), F.lit("")))
    absent = (e != "") & ~F.contains(match_text(F.coalesce(F.col(source), F.lit(""))), match_text(e))
    flags = {"n_facts": F.lit(1), "no_evidence": e == "", "short": (e != "") & (F.length(e) < least), "long": F.length(e) > most, "not_in_source": absent}
    rows = facts.select(key, F.col(field).alias("_f"), e.alias("_e"), *[c.cast("long").alias(n) for n, c in flags.items()])
    same = (F.count_distinct("_f") > 1) & (F.min("_e") == F.max("_e")) & (F.max("_e") != "")
    return rows.groupBy(key).agg(*[F.sum(n).alias(n) for n in flags], same.alias("same_evidence"))


def difficulty(text: Column, has_date: Column) -> Column:
    """Reasons why a text is hard: no date, short, tiers, indirect words, a time beside a date, several rates or amounts."""
    low = F.lower(text)
    rates = F.regexp_count(text, F.lit(PERCENT))
    several = F.when(rates >= 2, "rates").when(F.regexp_count(text, F.lit(AMOUNT)) >= 3, "amounts")
    indirect = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in INDIRECT])
    reasons = [F.when(~has_date, "no_date"), F.when(F.length(text) < SHORT_TEXT, "short"), F.when(F.regexp_count(text, F.lit(TIER)) >= 2, "tiers"), F.when(indirect, "indirect"), F.when(text.rlike(TIMED), "timed_date"), several]
    return F.array_compact(F.array(*reasons))


def lost_coverage(pages: DataFrame, old: str, new: str, facts: DataFrame, key: str, evidence: str, chars: int = 80) -> DataFrame:
    """Facts whose evidence (its first `chars` letters) stood in the old text of their page and is missing in the new one."""
    joined = facts.join(pages.select(key, F.col(old).alias("_old"), F.col(new).alias("_new")), key)
    start = F.substring(match_text(F.col(evidence)), 1, chars)
    return joined.filter(F.contains(match_text(F.col("_old")), start) & ~F.contains(match_text(F.col("_new")), start)).drop("_old", "_new")


def currency_anomalies(rates: DataFrame, key: list[str], currency: str, rate: str, a: str = "USD", b: str = "EUR") -> DataFrame:
    """Keys with rates in both currencies that differ. Both rates stay in the tables; this is a warning."""
    each = rates.filter(F.col(currency).isin(a, b)).groupBy(*key).agg(F.max(F.when(F.col(currency) == a, F.col(rate))).alias("rate_a"), F.max(F.when(F.col(currency) == b, F.col(rate))).alias("rate_b"))
    return each.filter("rate_a <> rate_b")


def fingerprint(df: DataFrame, ident: str) -> DataFrame:
    """One row: rows, largest id and an order-free digest of all columns, to tell whether a table has changed."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(ident).alias("max_id"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).alias("digest"))


def verify_export(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The manifest's tables whose files under path have another number of rows or another digest: none if all is well."""
    out = None
    for row in manifest.collect():  # a row per exported table
        lines = spark.read.text(f"{path}/{row['table']}")
        now = lines.agg(F.lit(row["table"]).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(20,0)")), F.lit(0)).alias("digest"))
        bad = now.filter((F.col("n_rows") != row["n_rows"]) | (F.col("digest") != row["digest"]))
        out = bad if out is None else out.unionByName(bad)
    return out
