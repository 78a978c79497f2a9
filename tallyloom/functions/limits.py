"""Limits of products from text: amounts, loan to value, vehicle age, allowed terms, bands, option labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions.text import fold, once

# Folded words of the language.
UPPER_WORDS = parse.any_of("kadar", "azami", "en fazla", "en cok", "maksimum", "ustu degil*")
LOWER_WORDS = parse.any_of("basla*", "asgari", "en az", "minimum", "uzeri*", "itibaren")
WORTH = ("ekspertiz*", "gayrimenkul*", "konut*", "arac*", "tasit*", "deger*")
NEW_ONES, USED_ONES = ("sifir km", "sifir arac*", "sifir tasit*", "0 km", "0km"), ("ikinci el*", "2 el*", "2. el*")
TL = parse.any_of("tl", "₺")
AMOUNT = rf"({parse.NUMBER}){parse.MULTIPLIER}"
#: A percentage after what is worth how much, or before the word for financing.
LTV_SHAPES = (rf"{parse.any_of(*WORTH)}\s+deger[^%]{{0,30}}%\s*(\d{{1,3}})", r"%\s*(\d{1,3})[^%.]{0,20}?finansman")


def _folded(text: Column, ready: bool) -> Column:
    """A text that is parsed in several ways is folded once, in a projection before, and said to be ready."""
    return text if ready else fold(text)


def _number(low: Column, shape: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(low, shape, group), F.lit("")).try_cast("int")


def _amount(low: Column, shape: str, group: int) -> Column:
    """The amount whose number and multiplier are two groups of the shape."""
    return parse._times(parse.decimal_tr(F.regexp_extract(low, shape, group)), F.regexp_extract(low, shape, group + 1))


def amount_limit(text: Column, ready: bool = False) -> Column:
    """struct<lo, hi>: a range with a currency sign at one end and two different ends, else a single amount with a currency
    sign if the words say (only) upper or (only) lower bound; a lower bound of 0 is none."""
    low = _folded(text, ready)
    times, sign = f"{'|'.join(parse.MULTIPLES)}?", f"{TL}?"
    amount = lambda n, after: parse._times(parse.decimal_tr(n), parse.times_in(after))
    joined = lambda p: parse.begins(p["after"], times, sign, "-\\s*$") & (parse.begins(p["after"], times, TL) | parse.begins(p["then"], times, TL))
    pair = once(parse.first_of(parse.followed(low), joined), lambda p: F.when(p.isNotNull(), F.struct(amount(p["n"], p["after"]).alias("a"), amount(p["m"], p["then"]).alias("b"))))
    a, b = pair["a"], pair["b"]
    least, most = F.least(a, b), F.greatest(a, b)
    one = _amount(low, rf"{AMOUNT}\s*{TL}", 1)
    up, down = low.rlike(UPPER_WORDS), low.rlike(LOWER_WORDS)
    ranged = a.isNotNull() & b.isNotNull() & (a != b)
    lo = F.when(ranged, F.when(least > 0, least)).when(down & ~up, one)
    hi = F.when(ranged, most).when(up & ~down, one)
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def ltv_percent(text: Column, ready: bool = False) -> Column:
    """The largest loan as percent of the value, 1 to 100."""
    low = _folded(text, ready)
    found = F.coalesce(*[_number(low, s, 1) for s in LTV_SHAPES])
    return F.when(found.between(1, 100), found)


def vehicle_age(text: Column, ready: bool = False) -> Column:
    """struct<lo, hi> in years: "0-3 yaş", new, "up to 5", used (1 and older)."""
    years = lambda n: F.when(F.length(n) <= 2, n.try_cast("int"))

    def read(low: Column, rows: Column) -> Column:
        span = parse.first_of(rows, lambda p: (F.trim(p["after"]) == "-") & parse.begins(p["then"], "yas"))
        most = parse.first_of(rows, lambda p: parse.begins(p["after"], r"yas\w*", "kadar"))
        found = F.struct(years(span["n"]).alias("a"), years(span["m"]).alias("b"), years(most["n"]).alias("most"), low.rlike(parse.any_of(*NEW_ONES)).alias("new"))
        used = low.rlike(parse.any_of(*USED_ONES))

        def told(x: Column) -> Column:
            lo = F.when(x["a"].isNotNull(), x["a"]).when(x["new"], 0).when(x["most"].isNotNull(), None).when(used, 1)
            hi = F.when(x["a"].isNotNull(), x["b"]).when(x["new"], 0).when(x["most"].isNotNull(), x["most"])
            return F.struct(lo.alias("lo"), hi.alias("hi"))

        return once(found, told)

    return once(_folded(text, ready), lambda low: once(parse.followed(low), lambda rows: read(low, rows)))


def with_limits(df: DataFrame, text: str) -> DataFrame:
    """df with amount_min, amount_max, term_months_min, term_months_max, allowed_terms, ltv_max_pct, limit_source and
    limit_evidence; the source is `none` and the evidence null if nothing was found. In steps, so that each shape is
    matched once a row."""
    steps = df.withColumn("_low", fold(F.col(text)))
    steps = steps.withColumns({"_amounts": amount_limit(F.col("_low"), True), "_terms": parse.allowed_terms(F.col("_low"), True), "ltv_max_pct": ltv_percent(F.col("_low"), True)})
    terms = F.when(F.size("_terms") > 0, F.col("_terms"))
    some = F.coalesce("_amounts.lo", "_amounts.hi").isNotNull() | (F.size("_terms") > 0) | F.col("ltv_max_pct").isNotNull()
    made = {"amount_min": F.col("_amounts.lo"), "amount_max": F.col("_amounts.hi"), "term_months_min": F.array_min(terms), "term_months_max": F.array_max(terms), "allowed_terms": terms}
    evidence = F.substring(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), 1, 300)
    found = F.coalesce(some, F.lit(False))
    return steps.withColumns(made | {"limit_source": F.when(found, "text").otherwise("none"), "limit_evidence": F.when(found, evidence)}).drop("_low", "_amounts", "_terms")


def value_band(text: Column, ready: bool = False) -> Column:
    """struct<lo, hi> of "değer <= 5 milyon", "5 milyon < değer <= 7 milyon", "10 milyon üzeri", "100 - 200"."""
    word = r"\s*(?:tl)?\s*"
    upper = rf"^[a-z\s]*(?:<=|<|≤)\s*{AMOUNT}{word}$|^{AMOUNT}{word}(?:ye|ya|e|a)?\s*(?:kadar|alti|ve alti)"
    both = rf"^{AMOUNT}{word}(?:<=|<|≤|-)[a-z\s]*(?:<=|<|≤)?\s*{AMOUNT}"
    lower = rf"^[a-z\s]*(?:>=|>|≥)\s*{AMOUNT}|^{AMOUNT}{word}(?:ve\s+)?(?:uzeri|ustu|uzerinde)"

    def told(low: Column, top: Column, pair: Column) -> Column:
        bottom = F.coalesce(_amount(low, lower, 1), _amount(low, lower, 3))
        a, b = pair["a"], pair["b"]
        ranged = a.isNotNull() & b.isNotNull()
        return F.struct(F.when(top.isNotNull(), None).when(ranged, F.least(a, b)).otherwise(bottom).alias("lo"), F.when(top.isNotNull(), top).when(ranged, F.greatest(a, b)).alias("hi"))

    def read(low: Column) -> Column:
        top = F.coalesce(_amount(low, upper, 1), _amount(low, upper, 3))
        pair = F.struct(_amount(low, both, 1).alias("a"), _amount(low, both, 3).alias("b"))
        return once(top, lambda t: once(pair, lambda p: told(low, t, p)))

    return once(_folded(text, ready), read)


def term_header(text: Column, ready: bool = False) -> Column:
    """struct<months, days_min, days_max> of a column head: "31 Günlük", "3 Aylık", "1 Yıl", "1 yıldan uzun"."""

    def told(low: Column, x: Column) -> Column:
        days, months, years = x["gun"], x["ay"], x["yil"]
        bare = low.rlike("yil") & years.isNull() & months.isNull() & days.isNull()
        out = F.when(days.isNotNull(), F.when(days >= 30, 1)).when(months.isNotNull(), months).when(years.isNotNull(), years * 12).when(bare, 12)
        return F.struct(out.alias("months"), F.when(days.isNotNull(), days).when(months.isNull() & bare, 366).alias("days_min"), days.alias("days_max"))

    def read(low: Column) -> Column:
        return once(F.struct(*[_number(low, rf"(\d+)\s*{unit}", 1).alias(unit) for unit in ("gun", "ay", "yil")]), lambda x: told(low, x))

    return once(_folded(text, ready), read)


def option_limits(label: Column) -> Column:
    """struct<name, term_min, term_max, amount_min, amount_max> of a choice like "TAŞIT FİNANSMANI (1-48 AY)"."""
    joined = lambda rows, unit: parse.first_of(rows, lambda p: (F.trim(p["after"]) == "-") & parse.begins(p["then"], unit))

    def told(plain: Column, name: Column, term: Column, amount: Column) -> Column:
        lo = once(parse.decimal_tr(amount["n"]), lambda n: F.when(n > 0, n))
        return F.struct(F.when(name == "", plain).otherwise(name).alias("name"), term["n"].try_cast("int").alias("term_min"), term["m"].try_cast("int").alias("term_max"), lo.alias("amount_min"), parse.decimal_tr(amount["m"]).alias("amount_max"))

    def read(plain: Column) -> Column:
        inside = fold(F.regexp_extract(plain, r"\(([^()]*)\)*\s*$", 1))
        name = F.trim(F.regexp_replace(plain, r"\([^()]*\)*\s*$", ""))
        found = once(once(inside, parse.followed), lambda rows: F.struct(name.alias("name"), joined(rows, "ay").alias("term"), joined(rows, "tl|₺").alias("amount")))
        return once(found, lambda x: told(plain, x["name"], x["term"], x["amount"]))

    return once(F.trim(F.regexp_replace(label, r"\s+", " ")), read)


def numbers_in(text: Column) -> Column:
    """The distinct numbers of a text in order of appearance; dates aren't numbers."""
    masked = F.regexp_replace(text, r"\b\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{2,4}\b", " ")
    tokens = F.regexp_extract_all(masked, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    groups = lambda t: F.translate(t, ".", "")
    value = lambda t: F.when(F.contains(t, F.lit(",")), F.translate(groups(t), ",", ".")).when(t.rlike(r"^\d+\.\d+$") & ~t.rlike(r"\.\d{3}$"), t).otherwise(groups(t)).try_cast("decimal(24,6)")
    return F.array_distinct(F.filter(F.transform(tokens, value), lambda x: x.isNotNull()))


def rate_range(text: Column) -> Column:
    """struct<lo, hi> of percentages: two in a text with range words, else one bounded by words, else one for both."""
    shape = rf"{parse.any_of('%', 'yüzde')}\s*{parse.NUMBER}|{parse.NUMBER}\s*%"
    bounds = lambda lo, hi: F.struct(lo.cast("decimal(20,6)").alias("lo"), hi.cast("decimal(20,6)").alias("hi"))

    def told(low: Column, tokens: Column) -> Column:
        x, y = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
        ranged = x.isNotNull() & y.isNotNull() & low.rlike(parse.RANGE_WORD + r"|%\s*\d[\d.,]*\s*-")
        single = lambda one: F.when(low.rlike(parse.LOWER_BOUND), bounds(one, F.lit(None))).when(low.rlike(parse.UPPER_BOUND), bounds(F.lit(None), one)).otherwise(bounds(one, one))
        return F.when(ranged, bounds(F.least(x, y), F.greatest(x, y))).otherwise(once(F.coalesce(x, parse.rate(low, True)), single))

    def read(low: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(low, F.lit(shape), F.lit(0)), lambda t: parse.decimal_tr(F.regexp_extract(t, parse.NUMBER, 0)))
        return once(tokens, lambda found: told(low, found))

    return once(parse.lowered(text), read)
