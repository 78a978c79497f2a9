"""Labels by keywords, validation of extracted facts against their source, entity cards."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.parse import number_spellings
from tallyloom.functions.text import fold, match_text, snippet, starts_word, tokens


def keyword_labels(docs: DataFrame, ident: str, scopes: dict[str, str], rules: list[tuple[str, str, str, float, tuple[str, ...]]], fallback: float = 0.30) -> DataFrame:
    """ident, axis, value, confidence, evidence. A rule is (axis, value, scope, confidence, keywords); a scope names a text
    column. Keywords match at the start of a word of the folded text. An axis without a match gets `other`. One label
    per axis and value stays, the surest."""
    ready = docs.select(ident, *[F.col(c).alias(f"_raw_{s}") for s, c in scopes.items()], *[fold(F.coalesce(F.col(c), F.lit(""))).alias(f"_{s}") for s, c in scopes.items()])
    made = []
    for axis, value, scope, confidence, words in rules:
        for word in words:
            low = F.col(f"_{scope}")
            hit = F.struct(F.lit(axis).alias("axis"), F.lit(value).alias("value"), F.lit(float(confidence)).alias("confidence"), snippet(low, F.lit(word.rstrip(" "))).alias("evidence"))
            made.append(F.when(starts_word(low, word), hit))
    axes = sorted({r[0] for r in rules})
    hits = F.array_compact(F.array(*made))
    missing = F.array_compact(F.array(*[F.when(~F.array_contains(F.col("hits.axis"), a), F.struct(F.lit(a).alias("axis"), F.lit("other").alias("value"), F.lit(fallback).alias("confidence"), F.lit(None).cast("string").alias("evidence"))) for a in axes]))
    rows = ready.select(ident, hits.alias("hits")).select(ident, F.explode(F.concat("hits", missing)).alias("l"))
    flat = rows.select(ident, "l.*")
    return flat.groupBy(ident, "axis", "value").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", "confidence").alias("evidence"))


def missing_axes(labels: DataFrame, ident: str, placeholder: str = "other", least: float = 0.5) -> DataFrame:
    """ident, axis of axes whose labels are all placeholders or unsure."""
    good = (F.col("value") != placeholder) & (F.col("confidence") >= least)
    return labels.groupBy(ident, "axis").agg(F.max(good.cast("int")).alias("good")).filter("good = 0").drop("good")


def known_only(labels: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    allowed = F.lit(False)
    for axis, values in vocabulary.items():
        allowed = allowed | ((F.col("axis") == axis) & F.col("value").isin(*values))
    return labels.filter(allowed)


def segment_of(url: Column, text: Column, paths: dict[str, str], words: dict[str, tuple[str, ...]]) -> Column:
    """By a path segment of the address, else by keywords, in order."""
    by_path = [F.when(F.contains(F.lower(url), F.lit(f"/{p}/")), v) for p, v in paths.items()]
    low = fold(text)
    by_word = [F.when(starts_word(low, w), v) for v, ws in words.items() for w in ws]
    return F.coalesce(*by_path, *by_word, F.lit(None).cast("string"))


def nearly_inside(wanted: str, text: str, least: float = 0.90) -> bool:
    """Whether the text, or one of its windows of twice the wanted length at steps of a quarter of it, is similar enough. As a
    window counts whole, it is the rule for texts hardly longer than what is wanted."""
    width, step = 2 * len(wanted), max(1, len(wanted) // 4)
    starts = [0] if len(text) <= width else range(0, len(text) - width + step, step)
    for at in starts:
        part = text[at : at + width]
        if 2 * min(len(part), len(wanted)) < least * (len(part) + len(wanted)):  # no ratio can be higher
            continue
        matcher = SequenceMatcher(None, wanted, part)
        if matcher.quick_ratio() >= least and matcher.ratio() >= least:  # the letters they share bound it
            return True
    return False


def similar_evidence(wanted: Column, text: Column) -> Column:
    """nearly_inside by row; false where either is null."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([bool(a and b) and nearly_inside(a, b) for a, b in zip(left, right, strict=True)], dtype="bool")

    return near(wanted, text)


def guard_reason(evidence: Column, source: Column, value: Column, exempt: Column) -> Column:
    """Why a found fact is rejected, or null: it has no evidence, the evidence isn't in the source (exactly, normalised or
    nearly; only what isn't contained is compared in Python), or its number isn't in the source in any spelling (zero and
    exempt units aside)."""
    text = match_text(source)
    number = value.try_cast("double")
    spelled = F.exists(number_spellings(number), lambda s: F.contains(text, s))
    found = F.contains(text, match_text(evidence))
    near = similar_evidence(F.when(~found, match_text(evidence)), F.when(~found, text))
    return (
        F.when(F.trim(F.coalesce(evidence, F.lit(""))) == "", "no_evidence")
        .when(~found & ~near, "evidence_not_in_source")
        .when(~exempt & number.isNotNull() & (number != 0) & ~spelled, "number_not_in_source")
    )


def logic_reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken; a rule about a missing field says nothing."""
    return F.array_compact(F.array(*[F.when(~r, F.lit(n)) for n, r in rules.items()]))


def forbidden_terms(text: Column, terms: tuple[str, ...], allowed: tuple[str, ...] = ()) -> Column:
    """The forbidden words of a text, outside allowed phrases."""
    low = fold(text)
    for phrase in allowed:
        low = F.replace(low, F.lit(phrase), F.lit(" "))
    return F.array_compact(F.array(*[F.when(starts_word(low, t), F.lit(t)) for t in terms]))


def card(parts: list[tuple[str, Column]]) -> Column:
    """Sentences of the fields that are there: "Label: value." joined by spaces."""
    return F.concat_ws(" ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string"), F.lit("."))) for label, c in parts])


def holds_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text holds one of the examples that a prompt shows, and so can't be asked about; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers], F.lit(False)), F.lit(False))


def unverified_numbers(answer: Column, cited: Column, least_digits: int = 2) -> Column:
    """Numbers of an answer, without separators, that the cited texts don't hold. Citations like [12] are no numbers."""
    bare = lambda c: F.regexp_replace(c, r"[.,\s]", "")
    pool = bare(F.coalesce(cited, F.lit("")))
    numbers = F.regexp_extract_all(F.regexp_replace(answer, r"\[\d+\]", " "), F.lit(r"\d[\d.,]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(numbers, bare), lambda n: (F.length(n) >= least_digits) & ~F.contains(pool, n)))


def summary_reason(summary: Column, source: Column, forbidden: tuple[str, ...], least: int = 40) -> Column:
    """Why a summary is rejected, or null: too short, a number that the source lacks, a forbidden word that the source
    doesn't use itself."""
    text = F.trim(F.coalesce(summary, F.lit("")))
    own = F.array_except(forbidden_terms(text, forbidden), forbidden_terms(F.coalesce(source, F.lit("")), forbidden))
    return F.when(F.length(text) < least, "empty_summary").when(F.size(unverified_numbers(text, source)) > 0, "unsupported_number").when(F.size(own) > 0, "forbidden_term")


def anchored_evidence(value: Column, text: Column, units: tuple[str, ...], window: int = 45, least: int = 12) -> Column:
    """The part of the text around a number in any spelling, no part of a longer number, with one of the units within
    `window` characters; null if there is none of at least `least` characters."""
    unit = "(?i:" + "|".join(f"\\Q{u}\\E" for u in units) + ")"
    around = f"[\\s\\S]{{0,{window}}}"

    def found(spelling: Column) -> Column:
        # The digits themselves are looked for first, what stands around them only where they are.
        number = F.concat(F.lit(r"(?<!\d)(?<!\d[.,])\Q"), spelling, F.lit(r"\E(?!\d)(?![.,]\d)"))
        pattern = F.concat(F.lit(rf"{around}(?=\Q"), spelling, F.lit(rf"\E)(?:(?<={unit}{around})"), number, F.lit("|"), number, F.lit(f"(?={around}{unit})){around}"))
        return F.when(F.contains(text, spelling), F.regexp_substr(text, pattern))

    parts = F.filter(F.transform(number_spellings(value.try_cast("double")), found), lambda p: p.isNotNull() & (F.length(p) >= least))
    return F.get(parts, F.lit(0))


def first_reward(text: Column, amount: str, totals: tuple[str, ...], near: int = 40) -> Column:
    """The first amount (a pattern) with no phrase of a common total within `near` characters before it; null if none."""
    total = "|".join(f"\\Q{t}\\E" for t in totals)
    return F.regexp_substr(text, F.lit(f"(?={amount})(?<!(?i:{total})[\\s\\S]{{0,{near}}})(?:{amount})"))


def merchant_labels(docs: DataFrame, ident: str, title: str, merchants: DataFrame, axis: str, sure: float = 0.9, doubt: float = 0.2) -> DataFrame:
    """ident, axis, value, confidence, evidence for titles that name a merchant (name, value, ambiguous) in whole words;
    names that also mean something else are less sure. Names and titles meet on a name's longest word, so no title is
    held against the whole dictionary. The surest, then smallest, name of a value is its evidence."""
    names = merchants.select(tokens(F.col("name")).alias("_words"), "name", "value", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
    keyed = names.filter(F.size("_words") > 0).withColumn("_word", F.array_max(F.transform("_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    padded = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    titles = docs.select(ident, tokens(F.col(title)).alias("_title"))
    met = titles.withColumn("_word", F.explode(F.array_distinct("_title"))).join(keyed, "_word").filter(F.contains(padded(F.col("_title")), padded(F.col("_words"))))
    confidence = F.when(F.col("ambiguous"), F.lit(sure - doubt)).otherwise(F.lit(sure))
    best = met.withColumn("confidence", F.round(confidence, 2)).groupBy(ident, "value").agg(F.max("confidence").alias("confidence"), F.min_by("name", F.struct(-F.col("confidence"), F.col("name"))).alias("evidence"))
    return best.select(ident, F.lit(axis).alias("axis"), "value", "confidence", "evidence")


def merged_labels(docs: DataFrame, ident: str, sources: list[DataFrame], fallbacks: dict[str, str], least: float = 0.30, boosted: tuple[str, str, str] | None = None) -> DataFrame:
    """Labels (ident, axis, value, confidence, evidence) of several sources as one list: of an axis's value the surest stays,
    then the smaller evidence. Documents without a label on an axis of `fallbacks` get its value there at `least`.
    `boosted` (axis, value, other): where both values stand on the axis, the first gains 0.05, to 0.95 at most."""
    every = reduce(lambda a, b: a.unionByName(b), sources)
    best = every.groupBy(ident, "axis", "value").agg(F.max("confidence").alias("confidence"), F.min_by("evidence", F.struct(-F.col("confidence"), F.col("evidence"))).alias("evidence"))
    if boosted:
        axis, value, other = boosted
        paired = F.max((F.col("value") == other).cast("int")).over(Window.partitionBy(ident, "axis")) == 1
        gains = (F.col("axis") == axis) & (F.col("value") == value) & paired
        best = best.withColumn("confidence", F.when(gains, F.greatest("confidence", F.least(F.round(F.col("confidence") + 0.05, 3), F.lit(0.95)))).otherwise(F.col("confidence")))
    asked = F.explode(F.create_map(*[F.lit(x) for item in fallbacks.items() for x in item])).alias("axis", "value")
    rest = docs.select(ident, asked).join(best.select(ident, "axis").distinct(), [ident, "axis"], "left_anti")
    return best.unionByName(rest.select(ident, "axis", "value", F.lit(least).alias("confidence"), F.lit(None).cast("string").alias("evidence")))


#: Rules about the fields of a campaign, as (name, fields, least, most) of one field or (name, fields) of two in order; fixed values.
LOGIC = (
    ("tarih_sirasi", ("start_date", "end_date")), ("kar_payi_araligi", ("profit_rate_pct",), 0, 100), ("harcama_araligi", ("min_spend_try", "max_spend_try")), ("vade_araligi", ("term_months_max",), 1, 360),
    ("taksit_araligi", ("installment_count",), 1, 60), ("odul_negatif_degil", ("reward_amount_try",), 0, 10_000_000), ("iade_orani", ("cashback_pct",), 0, 100), ("finansman_araligi", ("financing_amount_min", "financing_amount_max")),
)


def campaign_logic(columns: list[str]) -> Column:
    """Names of the eight rules that a row of metrics breaks; a rule speaks only where all of its fields are there."""
    rules = {}
    for name, fields, *bounds in LOGIC:
        if all(f in columns for f in fields):
            rules[name] = F.col(fields[0]).between(*bounds) if bounds else F.col(fields[0]) <= F.col(fields[1])
    return logic_reasons(rules)
