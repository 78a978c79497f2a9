"""Products of banks: limit matrices and payment plans from table cells, limits of a page, variants by name, parents of
variants, nested seeds. Cells are (page_id, table_no, row_no, col_no, text, caption), as functions.html.exploded gives them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions.text import fold

TABLE = ["page_id", "table_no"]
# Folded words of column heads and rows.
VALUE_WORDS = ("fatura", "kasko", "deger", "arac", "tasit")
MATRIX_WORDS = (("fatura", "kasko", "arac", "tasit"), ("oran", "finansman"), ("vade",))
PLAN_HEAD, PLAN_TOTAL, PLAN_BALANCE = "taksit no", "toplam", "kalan"
#: What a column of a payment plan holds, by words of its head, the first that fits.
PLAN_COLUMNS = {"principal": ("ana para", "anapara"), "profit": ("kar tutari", "kar payi"), "repayment": ("taksit tutari", "odeme tutari")}
#: Words of a seed: the variant that is none, and the kind of rate that is a share.
SEED_PLAIN, SEED_SHARE = "normal", "profit_sharing_ratio"


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _in_line(columns: str = "text") -> Column:
    """The cells of a grouped row from left to right."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", columns))), lambda c: c[columns]), " | ")


def vehicle_limits(cells: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, value_lo, value_hi, ratio, term_months_max, evidence of the tables whose first row names a
    vehicle's value, a ratio and a term. Of several columns of a kind the leftmost counts; a table of three columns or more
    without a named value has it in its first. A ratio that can't be read but holds a 0 is 0; rows that are too short for
    the columns are left out; null cells are empty."""
    cells = cells.withColumn("text", F.coalesce("text", F.lit("")))
    head = fold(F.col("text"))
    kind = F.when(F.contains(head, F.lit("vade")), "term").when(_any(head, ("oran", "%")), "ratio").when(_any(head, VALUE_WORDS), "value")
    heads = cells.filter("row_no = 0").select(*TABLE, "col_no", head.alias("text"), kind.alias("kind"))
    at = {k: F.min(F.when(F.col("kind") == k, F.col("col_no"))) for k in ("value", "ratio", "term")}
    value_at = F.coalesce(at["value"], F.when(F.count(F.lit(1)) >= 3, 0)).alias("value_at")
    whole = reduce(lambda a, b: a & b, [_any(F.col("_line"), words) for words in MATRIX_WORDS])
    tables = heads.groupBy(*TABLE).agg(_in_line().alias("_line"), value_at, at["ratio"].alias("ratio_at"), at["term"].alias("term_at")).filter(whole).dropna(subset=["value_at", "ratio_at", "term_at"])
    body = cells.filter("row_no > 0").join(tables.drop("_line"), TABLE)
    picked = [F.max(F.when(F.col("col_no") == F.col(f"{k}_at"), F.col("text"))).alias(k) for k in at]
    rows = body.groupBy(*TABLE, "row_no").agg(*picked, _in_line().alias("evidence")).dropna(subset=list(at))
    band, months = parse.money_range(F.col("value")), parse.term_months(F.col("term"))
    ratio = F.coalesce(parse.rate(F.col("ratio")), F.when(F.contains("ratio", F.lit("0")), F.lit(0).cast("decimal(20,6)")))
    return rows.select(*TABLE, "row_no", band["lo"].alias("value_lo"), band["hi"].alias("value_hi"), ratio.alias("ratio"), F.coalesce(months["hi"], months["lo"]).alias("term_months_max"), "evidence")


def plan_totals(cells: DataFrame) -> DataFrame:
    """page_id, table_no, term_months, principal, profit, repayment, evidence of payment plans: tables with a row that heads
    the instalments' numbers, a column of the principal, and a row of totals below one instalment or more. The term counts the rows between; amounts
    come from the totals alone, columns of what remains due are no principal. Amounts that aren't there are null."""
    c = lambda name: lambda x: x[name]
    has = lambda phrase: F.contains("_t", F.lit(phrase))
    word = F.coalesce(*[F.when(_any(F.col("_t"), words), F.lit(k)) for k, words in PLAN_COLUMNS.items()])
    read = cells.withColumn("_t", fold(F.coalesce("text", F.lit("")))).select(
        *TABLE, F.struct("row_no", "col_no", "text", F.when(~has(PLAN_BALANCE), word).alias("kind")).alias("_cell"), F.when(has(PLAN_HEAD), F.col("row_no")).alias("_head"), F.when((F.col("col_no") == 0) & has(PLAN_TOTAL), F.col("row_no")).alias("_end")
    )
    tables = read.groupBy(*TABLE).agg(F.collect_list("_cell").alias("_cells"), F.min("_head").alias("_head"), F.collect_set("_end").alias("_ends")).filter("_head is not null")
    plans = tables.withColumn("_end", F.array_min(F.filter("_ends", lambda n: n > F.col("_head")))).filter("_end is not null")
    row = lambda n: F.filter("_cells", lambda x: x["row_no"] == F.col(n))
    between = F.filter(F.transform("_cells", c("row_no")), lambda n: (n > F.col("_head")) & (n < F.col("_end")))
    plans = plans.select(*TABLE, row("_head").alias("_heads"), row("_end").alias("_total"), F.size(F.array_distinct(between)).alias("term_months")).filter("term_months > 0")
    at = lambda k: F.array_min(F.transform(F.filter("_heads", lambda x: x["kind"] == k), c("col_no")))
    plans = plans.withColumns({f"_{k}": at(k) for k in PLAN_COLUMNS}).filter("_principal is not null")
    amount = lambda k: F.array_max(F.transform(F.filter("_total", lambda x: x["col_no"] == F.col(f"_{k}")), lambda x: parse.money(x["text"])))
    evidence = F.array_join(F.transform(F.array_sort(F.transform("_total", lambda x: F.struct(x["col_no"].alias("c"), x["text"].alias("t")))), c("t")), " | ")
    return plans.select(*TABLE, "term_months", *[amount(k).alias(k) for k in PLAN_COLUMNS], evidence.alias("evidence"))


def page_limits(pages: DataFrame, form: dict[str, str], text: dict[str, str], above_zero: Sequence[str] = ("amount_max",), out: str = "limits_source") -> DataFrame:
    """pages with a column for each limit (the dicts name its column by form and by text): what the form states, else what
    the text says. A bound of 0 in `above_zero` is no limit. `out` names the weakest source that gave one: `text` before
    `html_attr`, `none` without any."""
    made, from_text, from_form = {}, F.lit(False), F.lit(False)
    for name in dict.fromkeys((*form, *text)):
        known = [F.nullif(F.col(d[name]), F.lit(0)) if name in above_zero else F.col(d[name]) for d in (form, text) if name in d]
        made[name] = F.coalesce(*known)
        if name in form:
            from_form = from_form | known[0].isNotNull()
        if name in text:
            from_text = from_text | (known[-1].isNotNull() & (known[0].isNull() if name in form else F.lit(True)))
    return pages.withColumns(made | {out: F.when(from_text, "text").when(from_form, "html_attr").otherwise("none")})


def variant_of(label: Column, patterns: Sequence[tuple[str, str, Sequence[str]]]) -> Column:
    """struct<dimension, key> of the first pattern (dimension, key, folded words) with a word that the label holds; else of
    the key that the label itself spells; null if nothing fits: a variant is never guessed."""
    low = fold(label)
    slug = F.translate(low, " -", "__")
    named = lambda d, k: F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("key"))
    hits = [F.when(_any(low, words), named(d, k)) for d, k, words in patterns if words]
    return F.coalesce(*hits, *[F.when(slug == k, named(d, k)) for d, k, _ in patterns])


def with_parents(products: DataFrame, stored: DataFrame, bank: str = "bank", key: str = "external_key", parent: str = "parent_external_key") -> DataFrame:
    """products with `reason`: `parent_missing` for variants whose parent is neither a root among them nor stored for the
    same bank, null for rows that may be written."""
    roots = products.filter(F.col(parent).isNull()).select(bank, F.col(key).alias(parent))
    known = roots.union(stored.select(bank, key)).distinct().withColumn("_known", F.lit(True))
    lost = F.col(parent).isNotNull() & F.col("_known").isNull()
    return products.join(known, [bank, parent], "left").withColumn("reason", F.when(lost, "parent_missing")).select(*products.columns, "reason")


#: Type of the file of seeds, for a reader with multiLine.
SEED_TYPE = "datasets array<struct<rate_type:string,variant:string,rows:array<struct<bank_code:string,values:map<string,string>,evidence_text:string>>,not_offered_banks:array<string>>>"


def seed_rates(seeds: DataFrame, banks: DataFrame, months: dict[str, int]) -> DataFrame:
    """bank_code, variant, availability, rate_type, term_label, term_months, currency, rate, investor_share, bank_share,
    evidence of nested seeds (SEED_TYPE): a row per value under its `label|currency`; banks that don't offer the product
    have a row without values. Unknown banks and labels, and values that are no numbers, are left out. Shares fill up to 100."""
    sets = seeds.select(F.explode("datasets").alias("d")).select("d.*").withColumn("variant", F.nullif(F.col("variant"), F.lit(SEED_PLAIN)))
    rows = sets.select("rate_type", "variant", F.explode("rows").alias("r"))
    cells = rows.select("rate_type", "variant", F.col("r.bank_code").alias("bank_code"), F.col("r.evidence_text").alias("evidence"), F.explode("r.values").alias("cell", "value"))
    label, value = F.split_part("cell", F.lit("|"), F.lit(1)), F.col("value").try_cast("decimal(20,6)")
    month = F.try_element_at(F.create_map(*[F.lit(x) for item in months.items() for x in item]), label)
    share = F.col("rate_type") == SEED_SHARE
    told = F.coalesce("evidence", F.concat(label, F.lit(": "), F.col("value")))
    offered = cells.select(
        "bank_code", "variant", F.lit("offered").alias("availability"), "rate_type", label.alias("term_label"), month.alias("term_months"), F.split_part("cell", F.lit("|"), F.lit(2)).alias("currency"),
        F.when(~share, value).alias("rate"), F.when(share, value).alias("investor_share"), F.when(share, (100 - value).cast("decimal(20,6)")).alias("bank_share"), told.alias("evidence"), value.alias("_value")).filter("term_months is not null and _value is not null").drop("_value")
    absent = sets.select(F.explode("not_offered_banks").alias("bank_code"), "variant", F.lit("not_offered").alias("availability"))
    return offered.unionByName(absent, allowMissingColumns=True).join(banks.select("bank_code").distinct(), "bank_code", "left_semi")
