"""Facts from campaign texts by rules: one row per field found, with raw text, unit, evidence and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import annotate, parse
from tallyloom.functions.text import once, snippet

# What a number near such words is not (a rate).
NOT_A_RATE = r"indirim|iade|cashback|puan|bonus|finanse|kredilendir|oranında ödül"
#: The words that make a percentage a rate of profit; from SHARE on it is one beside these words only.
PROFIT, SHARE = r"k[âa]r pay[ıi]", 50
#: Spellings of a percentage, and how many letters on either side tell what it is.
PERCENTAGE, NEAR = rf"%\s*{parse.NUMBER}|{parse.NUMBER}\s*%|yüzde\s*{parse.NUMBER}", 40


def _before(x: Column, i: Column) -> Column:
    """The last NEAR letters before the percentage of number i: of the text between it and the last one, and of those before."""
    first = F.greatest(F.lit(0), i - NEAR // 2)
    pieces = F.zip_with(F.slice(x["between"], first + 1, i - first), F.slice(x["said"], first + 1, i - first), lambda t, raw: F.concat(t, raw))
    return F.right(F.concat(F.array_join(pieces, ""), F.get(x["between"], i)), F.lit(NEAR))


def profit_rate(low: Column) -> Column:
    """struct<value, raw> of a lowered text's rate of profit, or null. Every percentage is judged by the letters around it:
    beside words of discounts or rebates, or from 50 on, it is one only if it is called so. Of several different ones those called so
    decide; if they differ too, none is taken. "No term difference" is a rate of 0 where nothing else is found."""
    said, ahead = (F.regexp_extract_all(low, F.lit(rf"({PERCENTAGE})(?=([\s\S]{{0,{NEAR}}}))"), F.lit(g)) for g in (1, 2))
    # A percentage has two letters at least, so that what stands before one lies in NEAR / 2 others and the texts between.
    between = F.split(low, PERCENTAGE, -1)
    told = once(F.struct(said.alias("said"), ahead.alias("ahead"), between.alias("between")), lambda x: F.transform(x["said"], lambda raw, i: F.struct(raw.alias("raw"), F.concat(_before(x, i), raw, F.get(x["ahead"], i)).alias("near"))))
    judge = lambda m: F.struct(parse.rate(m["raw"], True).alias("value"), m["raw"].alias("raw"), m["near"].alias("near"))
    named = lambda r: r["near"].rlike(PROFIT)
    is_rate = lambda r: r["value"].isNotNull() & (named(r) | ((r["value"] < SHARE) & ~r["near"].rlike(NOT_A_RATE)))
    single = lambda found: F.when(F.size(F.array_distinct(F.transform(found, lambda r: r["value"]))) == 1, F.get(found, F.lit(0)))
    judged = F.filter(F.transform(told, judge), is_rate)
    pick = once(judged, lambda rates: F.coalesce(single(rates), single(F.filter(rates, named))))
    zero = F.regexp_extract(low, parse.ZERO_RATE, 0)
    none = F.when(zero != "", F.struct(F.lit(0).cast("decimal(20,6)").alias("value"), zero.alias("raw")))
    made = once(pick, lambda p: F.when(p.isNotNull(), F.struct(p["value"].alias("value"), p["raw"].alias("raw"))))
    return F.coalesce(F.when(low.rlike("%|yüzde"), made), none)


#: How far a mark may stand from a number that it speaks about, and an instalment from a term.
FAR, TERM_FAR = 40, 15
#: Marks of other percentages, of rewards, of kinds of reward in order.
TRAPS = ("discount", "cheap", "cash", "guard")
GAINS = ("loyal", "cash", "back", "prize", "gift", "discount")
REWARD_KINDS = (("nakit_iade", ("cash",)), ("puan", ("loyal",)), ("hediye", ("gift",)), ("ucret_muafiyeti", ("nofee",)), ("indirim", ("discount", "cheap")), ("taksit", ("instalment", "count")))
SURE, UNSURE = 0.90, 0.60
MONTHS_OF_YEAR = 12


def _numbers(raw: Column) -> Column:
    """The scanned numbers with their value, the kinds beside them (a1 to a3 behind, b1 to b3 before, x behind an "up to") and the
    places where what is said ends (behind) or begins (before)."""

    def one(n: Column) -> Column:
        skip = n["a1"] == "until"
        same = [n[f"{side}{k}"].alias(f"{side}{k}") for side in "abes" for k in (1, 2, 3)]
        value = (parse.decimal_tr(n["token"]) * n["times"]).cast("decimal(20,6)")
        return F.struct(value.alias("v"), n["unit"].alias("unit"), n["s"].alias("s"), n["e"].alias("e"), *same, F.when(skip, n["a2"]).otherwise(n["a1"]).alias("x"), F.when(skip, n["e2"]).otherwise(n["e1"]).alias("ex"))

    return F.filter(F.transform(raw, one), lambda n: n["v"].isNotNull())


def _near(marks: Column, n: Column, far: int, *kinds: str) -> Column:
    """Whether a mark of a kind reaches into the letters up to `far` from the number."""
    return F.exists(marks, lambda m: m["kind"].isin(*kinds) & (m["s"] < n["e"] + far) & (m["e"] > n["s"] - far))


def _pick(numbers: Column, when, begin=lambda n: n["s"], end=lambda n: n["e"]) -> Column:
    """The first number for which the rule holds, as struct<v, s, e>."""
    return once(F.get(F.filter(numbers, when), F.lit(0)), lambda n: F.when(n.isNotNull(), F.struct(n["v"].alias("v"), F.coalesce(begin(n), n["s"]).alias("s"), F.coalesce(end(n), n["e"]).alias("e"))))


def _first_mark(marks: Column, *kinds: str) -> Column:
    return F.get(F.filter(marks, lambda m: m["kind"].isin(*kinds)), F.lit(0))


def _rates(numbers: Column, marks: Column) -> Column:
    """array<struct<v, s, e, named>> of the percentages that are rates of profit. Each is called so beside it (named) or stands by
    a word of rates; marks of other percentages near it, or a value of SHARE and more, take a "profit share" near it to be one.
    If they differ, those called so decide, and if these differ too, none is taken."""
    named = lambda n: (n["b1"] == "profit") | ((n["b1"] == "rate") & (n["b2"] == "profit")) | (n["a1"] == "profit")
    through = lambda *kinds: reduce(lambda a, k: a & ~k.isin("stop", "num", "", "pct"), kinds, F.lit(True))
    leads = lambda k: k.isin("context", "cheap")
    led = lambda n: leads(n["b1"]) | (leads(n["b2"]) & through(n["b1"])) | (leads(n["b3"]) & through(n["b1"], n["b2"]))
    told = lambda n: (n["unit"] == "pct") & (named(n) | (n["a1"] == "rate") | led(n))
    fits = lambda n: told(n) & (_near(marks, n, FAR, "profit", "context") | ((n["v"] < SHARE) & ~_near(marks, n, FAR, *TRAPS)))
    found = F.transform(F.filter(numbers, fits), lambda n: F.struct(n["v"].alias("v"), F.when(n["b1"] == "profit", n["s1"]).when(named(n) & (n["b1"] == "rate"), n["s2"]).otherwise(n["s"]).alias("s"), F.when(n["a1"].isin("profit", "rate"), n["e1"]).otherwise(n["e"]).alias("e"), named(n).alias("named")))
    values = lambda rates: F.size(F.array_distinct(F.transform(rates, lambda r: r["v"])))

    def decided(rates: Column) -> Column:
        own = F.filter(rates, lambda r: r["named"])
        return F.when(values(rates) <= 1, rates).when(values(own) == 1, F.slice(own, 1, 1)).otherwise(F.slice(rates, 1, 0))

    return once(found, decided)


def rule_facts(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, field, value, unit, raw, evidence, at (place in the text), confidence: the facts that rules find in a text, each a
    row, in up to 19 fields. A text is scanned once for marks and numbers; every field is a rule over the marks beside a
    number or near it. What is not said gives no row: an upper limit makes no lower one. Evidence is the text at the place."""
    ready = parse.with_date_range(docs.select(F.col(ident), F.col(text).alias("_text"), parse.lowered(F.col(text)).alias("_low")), "_low", "_period", True)
    # The first date of the text is looked for and cut out once, and only where a period was found.
    dates = F.regexp_extract("_low", r"\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{4}|\d{1,2}\s+\p{L}+\s+\d{4}", 0)
    cut = once(dates, lambda raw: F.struct(raw.alias("raw"), snippet(F.col("_low"), raw).alias("evidence"), F.instr(F.col("_low"), raw).alias("at")))
    ready = ready.withColumn("_date", F.when(F.coalesce("_period.start", "_period.end").isNotNull(), cut))
    ready = ready.withColumn("_scan", annotate.scanned("_text")).withColumns({"_numbers": _numbers(annotate.numbers_of("_scan")), "_marks": annotate.marks_of("_scan")})
    numbers, marks = F.col("_numbers"), F.col("_marks")
    money = lambda n: n["unit"] == "tl"
    pct = lambda n: n["unit"] == "pct"
    bare = lambda n: n["unit"] == ""
    alone = lambda n: ~F.exists(marks, lambda m: (m["kind"] == "each") & (m["e"] <= n["s"]) & (m["e"] > n["s"] - FAR))
    left = lambda *kinds: (lambda n: F.when(n["b1"].isin(*kinds), n["s1"]))
    # Two numbers with a sign between them are one thing said: struct<lo, hi, s, e, close> with the kind that follows.
    pairs = F.filter(
        F.zip_with(numbers, F.slice(numbers, 2, F.size(numbers)), lambda n, m: F.struct(n.alias("n"), m.alias("m"))),
        lambda p: p["m"].isNotNull() & p["n"]["a1"].isin("dash", "slash") & p["n"]["a2"].isin("num", "pct"),
    )
    ready = ready.withColumns({
        "_pairs": pairs,
        "_rates": _rates(numbers, marks),
        "_least": _pick(numbers, lambda n: money(n) & ((n["b1"] == "least") | (n["a1"] == "above")), left("least"), lambda n: F.when(n["a1"] == "above", n["e1"])),
        "_tops": F.filter(numbers, lambda n: money(n) & n["a1"].isin("until", "below")),
    })
    spends = F.filter("_pairs", lambda p: money(p["n"]) & money(p["m"]) & (p["n"]["a1"] == "dash") & (p["m"]["a1"] == "amid"))
    shares = F.filter("_pairs", lambda p: (p["n"]["a1"] == "slash") & ((p["m"]["a1"] == "share") | (p["n"]["b1"] == "share")))
    unit_of = lambda n: n["a1"].isin("month", "year")
    apart = lambda n: unit_of(n) & bare(n) & ~_near(marks, n, TERM_FAR + 4, "instalment", "count")
    spans = F.transform(F.filter("_pairs", lambda p: (p["n"]["a1"] == "dash") & bare(p["n"]) & apart(p["m"])), lambda p: F.struct(p["n"]["v"].alias("lo"), p["m"]["v"].alias("hi"), p["m"]["a1"].alias("unit"), F.lit("").alias("then"), p["n"]["s"].alias("s"), p["m"]["e1"].alias("e")))
    singles = F.transform(F.filter(numbers, lambda n: apart(n) & ((n["b1"] != "dash") | (n["b2"] != "num"))), lambda n: F.struct(n["v"].alias("lo"), n["v"].alias("hi"), n["a1"].alias("unit"), n["a2"].alias("then"), n["s"].alias("s"), n["e1"].alias("e")))
    top = F.aggregate("_tops", F.lit(None).cast("struct<v:decimal(20,6),s:int,e:int>"), lambda best, n: F.when(best.isNull() | (n["v"] > best["v"]), F.struct(n["v"].cast("decimal(20,6)").alias("v"), n["s"].alias("s"), F.coalesce(n["e1"], n["e"]).alias("e"))).otherwise(best))
    ready = ready.withColumns({
        "_spend": F.get(spends, F.lit(0)), "_share": F.get(shares, F.lit(0)), "_term": F.get(F.array_sort(F.concat(spans, singles), lambda a, b: a["s"] - b["s"]), F.lit(0)), "_top": top,
        "_financed": F.exists(marks, lambda m: m["kind"] == "financing"),
        "_zero": _first_mark(marks, "zero"), "_nofee": _first_mark(marks, "nofee"),
        "_count": _pick(numbers, lambda n: bare(n) & (n["a1"].isin("instalment", "count") | ((n["a1"] == "month") & (n["a2"] == "until") & (n["a3"] == "instalment")) | (n["b1"] == "count")), left("count"), lambda n: F.when(n["a1"].isin("instalment", "count"), n["e1"]).when(n["a1"] == "month", n["e3"])),
        "_reward": _pick(numbers, lambda n: money(n) & n["x"].isin(*GAINS) & alone(n), end=lambda n: n["ex"]),
        "_loyal": _pick(numbers, lambda n: (money(n) | bare(n)) & (n["x"] == "loyal") & alone(n), end=lambda n: n["ex"]),
        "_finance": _pick(numbers, lambda n: money(n) & ((n["x"] == "financing") | (n["b1"] == "financing")), left("financing"), lambda n: F.when(n["x"] == "financing", n["ex"])),
        "_cashback": _pick(numbers, lambda n: pct(n) & (n["x"].isin("cash", "back") | ((n["a1"] == "rate") & n["a2"].isin("cash", "back")) | n["b1"].isin("cash", "back")), left("cash", "back"), lambda n: F.when(n["x"].isin("cash", "back"), n["ex"]).when(n["a1"] == "rate", n["e2"])),
        "_discount": _pick(numbers, lambda n: pct(n) & ((n["x"] == "discount") | (n["b1"] == "discount")), left("discount"), lambda n: F.when(n["x"] == "discount", n["ex"])),
        "_allocation": _pick(numbers, lambda n: ~money(n) & ((n["b1"] == "allocation") | (pct(n) & (n["a1"] == "allocation"))), left("allocation"), lambda n: F.when(n["a1"] == "allocation", n["e1"])),
        "_filefee": _pick(numbers, lambda n: money(n) & (n["b1"] == "filefee"), left("filefee")),
    })
    whole, zero = F.col("_text"), F.lit(0).cast("decimal(20,6)")

    def fact(field: str, value: Column, unit: str, where: Column, sure: Column | float = SURE) -> Column:
        raw = F.substring(whole, where["s"] + 1, where["e"] - where["s"])
        level = sure if isinstance(sure, Column) else F.lit(sure)
        return F.when(value.isNotNull() & where.isNotNull(), F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(unit).alias("unit"), raw.alias("raw"), raw.alias("evidence"), (where["s"] + 1).alias("at"), level.cast("double").alias("confidence")))

    c = F.col
    least, top, spend, term = c("_least"), c("_top"), c("_spend"), c("_term")
    at_spend = F.when(spend.isNotNull(), F.struct(spend["n"]["s"].alias("s"), spend["m"]["e1"].alias("e")))
    # A tier's end below an explicit minimum is no limit of the campaign.
    bound = lambda v: F.when(least.isNull() | (v > least["v"]), v)
    low_spend, high_spend = F.when(least.isNull(), spend["n"]["v"]), bound(spend["m"]["v"])
    high_top = F.when(spend.isNull(), bound(top["v"]))
    financed = lambda v: F.when(c("_financed"), v)
    months = lambda v: F.when(term["unit"] == "year", v * MONTHS_OF_YEAR).otherwise(v).cast("int")
    period, date_raw = c("_period"), c("_date.raw")
    dated = F.when(period["precision"] == "exact", SURE).otherwise(UNSURE)
    day = lambda field, value: F.when(value.isNotNull() & (date_raw != ""), F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit("date").alias("unit"), date_raw.alias("raw"), c("_date.evidence").alias("evidence"), c("_date.at").alias("at"), dated.cast("double").alias("confidence")))
    kinds = [(F.lit(name), _first_mark(marks, *of)) for name, of in REWARD_KINDS]
    reward_at = F.coalesce(*[at for _, at in kinds])
    reward = reduce(lambda out, x: out.when(x[1].isNotNull(), x[0]), kinds[1:], F.when(kinds[0][1].isNotNull(), kinds[0][0]))
    rates = F.transform("_rates", lambda r: fact("profit_rate_pct", r["v"], "pct", r, F.when(F.size("_rates") > 1, UNSURE).otherwise(SURE)))
    others = F.array(
        F.when(F.size("_rates") == 0, fact("profit_rate_pct", F.when(c("_zero").isNotNull(), zero), "pct", c("_zero"))),
        fact("profit_share_rate_pct", c("_share")["m"]["v"], "pct", F.when(c("_share").isNotNull(), F.struct(c("_share")["n"]["s"].alias("s"), c("_share")["m"]["e"].alias("e")))),
        fact("installment_count", c("_count")["v"].cast("int"), "count", c("_count")),
        fact("term_months_min", F.when(term["then"] != "until", months(term["lo"])), "month", term), fact("term_months_max", months(term["hi"]), "month", term),
        fact("min_spend_try", least["v"], "try", least), fact("min_spend_try", low_spend, "try", at_spend), fact("max_spend_try", high_spend, "try", at_spend), fact("max_spend_try", high_top, "try", top),
        fact("reward_amount_try", c("_reward")["v"], "try", c("_reward")), fact("loyalty_points", c("_loyal")["v"], "count", c("_loyal")),
        fact("financing_amount_max", c("_finance")["v"], "try", c("_finance")), fact("financing_amount_min", financed(low_spend), "try", at_spend), fact("financing_amount_max", financed(high_spend), "try", at_spend), fact("financing_amount_max", financed(high_top), "try", top),
        fact("cashback_pct", c("_cashback")["v"], "pct", c("_cashback")), fact("discount_pct", c("_discount")["v"], "pct", c("_discount")), fact("allocation_fee_pct", c("_allocation")["v"], "pct", c("_allocation")),
        fact("file_fee_try", c("_filefee")["v"], "try", c("_filefee")), fact("file_fee_try", F.when(c("_nofee").isNotNull() & c("_filefee").isNull(), zero), "try", c("_nofee")), fact("has_no_fee", F.when(c("_nofee").isNotNull(), "true"), "bool", c("_nofee")),
        day("start_date", period["start"]), day("end_date", period["end"]), fact("reward_type", reward, "enum", reward_at),
    )
    return ready.select(ident, F.explode(F.array_compact(F.concat(rates, others))).alias("f")).select(ident, "f.*")


def first_facts(facts: DataFrame, ident: str) -> DataFrame:
    """Per entity and field the fact that stands first in the text."""
    return facts.groupBy(ident, "field").agg(F.min_by(F.struct("value", "raw", "confidence"), F.struct("at", "value")).alias("f")).select(ident, "field", "f.*")


def text_metrics(docs: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """docs with a column per field: the value of the fact that stands first in the row's text (as first_facts has it); rows whose
    text says nothing of any field are left out. Equal texts are read once: their facts become one row in one shuffle and meet
    the rows by the text; a text of very many rows is no group of one task."""
    said = rule_facts(docs.select(text).filter(F.col(text).isNotNull()).distinct(), text, text).filter(F.col("field").isin(*fields))
    own = lambda f, c: F.when(F.col("field") == f, c)
    found = said.groupBy(text).agg(*[F.min_by(own(f, F.col("value")), own(f, F.struct("at", "value"))).alias(f) for f in fields])
    return docs.join(found.hint("merge"), text)
