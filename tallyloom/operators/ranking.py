"""Ranking that never hides missing data, extremum with coverage, scaling, scores, bands and nearest terms.

NULL is unknown, never zero: rows without the measure form a group of their own and are returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.staged import staged


def in_band(low: str, high: str, value) -> Column:
    """Open-ended band: a null bound is no bound; edges belong to it."""
    return (F.col(low).isNull() | (F.col(low) <= value)) & (F.col(high).isNull() | (F.col(high) >= value))


def rank_with_missing(df: DataFrame, measure: str, by: list[str], ident: str, descending: bool = False, limit: int | None = None, method: str = "row_number") -> DataFrame:
    """df with rank and status (ranked or no_data). Ranks are given before the limit, ties go by `ident`; rows without
    the measure keep a null rank and are never cut. Ranks are per `by` group, so pass groups to spread the work."""
    value = F.col(measure)
    order = [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col(ident)]
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.when(value.isNotNull(), getattr(F, method)().over(window)))
    ranked = ranked.withColumn("status", F.when(value.isNotNull(), "ranked").otherwise("no_data"))
    return ranked if limit is None else ranked.filter(F.col("rank").isNull() | (F.col("rank") <= limit))


def placed(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with the place (from 1) of every row in its group, under a total order, for groups of any size. Rows are dealt to tasks by
    ranges of (group, order), so a large group spans several; each task counts its own rows, and what stands before a range in
    the same group comes from the counts of the ranges. Rows are written once in between, so ranges stay what they were."""
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    spread = staged(dealt.sortWithinPartitions(*keys, *order), "ranges")
    counts = spread.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_range") == F.col("_r"))
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    both = spread.withColumn("_within", within).join(counts.select(*renamed, F.col("_range").alias("_r"), "_before"), same)
    return both.select(*df.columns, (F.col("_within") + F.col("_before")).alias(name))


#: Criteria by which campaigns are ranked: the field, and whether the highest comes first; fixed values.
CAMPAIGN_CRITERIA = {
    "en_yuksek_odul": ("reward_amount_try", True), "en_dusuk_kar_payi": ("profit_rate_pct", False), "en_uzun_vade": ("term_months_max", True),
    "en_yuksek_taksit": ("installment_count", True), "en_yuksek_iade_orani": ("cashback_pct", True), "en_yuksek_indirim": ("discount_pct", True),
}
#: Criteria by which products are ranked, with the only type of rate that has the field, if it is one; fixed values. A score
#: comes from weighted_score().
PRODUCT_CRITERIA = {
    "en_dusuk_kar_payi": ("profit_rate_pct", False, "financing_rate"), "en_dusuk_masraf": ("allocation_fee_pct", False, "financing_rate"), "en_dusuk_toplam_maliyet": ("annual_cost_pct", False, "financing_rate"),
    "en_yuksek_getiri": ("profit_rate_pct", True, "participation_yield"), "en_yuksek_paylasim_orani": ("investor_share_pct", True, "profit_sharing_ratio"), "en_uzun_vade": ("term_months", True, None), "en_avantajli": ("score", True, None),
}


#: Up to so many first rows of a group are kept by every task before the groups come together (Spark's threshold for this).
FIRST = 1000


def criterion_of(criterion: str, rate_type: str | None = None) -> tuple[str, bool]:
    """Field and direction of a criterion; ValueError for one that is not known or that the type of rate has no field for."""
    if rate_type is None:
        if criterion not in CAMPAIGN_CRITERIA:
            raise ValueError(f"unknown criterion {criterion!r}; known are {', '.join(CAMPAIGN_CRITERIA)}")
        return CAMPAIGN_CRITERIA[criterion]
    if criterion not in PRODUCT_CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}; known are {', '.join(PRODUCT_CRITERIA)}")
    field, descending, kind = PRODUCT_CRITERIA[criterion]
    if kind not in (None, rate_type):
        raise ValueError(f"{criterion!r} says nothing about rates of type {rate_type!r}")
    return field, descending


def rank_by(df: DataFrame, criterion: str, by: list[str], ident: str, limit: int | None = None, rate_type: str | None = None) -> DataFrame:
    """df with rank, status (ranked or no_data) and missing_reason under a criterion, in groups of any size. Ties go by `ident`.
    Rows without the field are a group of their own in order of `ident`, without a rank. `limit` keeps so many of either; as far as
    FIRST, each task passes on no more than that of a group, and nothing else is shuffled."""
    field, descending = criterion_of(criterion, rate_type)
    value = F.col(field)
    status = F.when(value.isNotNull(), "ranked").otherwise("no_data")
    order = [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col(ident)]
    if limit is not None and limit <= FIRST:
        out = df.withColumn("status", status).withColumn("place", F.row_number().over(Window.partitionBy(*by, "status").orderBy(*order)))
    else:
        out = placed(df.withColumn("status", status), [*by, "status"], order)
    kept = out if limit is None else out.filter(F.col("place") <= limit)
    missing = F.when(value.isNull(), F.lit(f"{field}: no data"))
    return kept.withColumns({"rank": F.when(value.isNotNull(), F.col("place")), "missing_reason": missing}).drop("place")


def extremum(df: DataFrame, by: list[str], measure: str, ident: str, kind: str = "min") -> DataFrame:
    """Per group: winner, value, with_value, without_value, ties (others with the value). Ties on the value go to the
    highest id for a minimum and to the lowest for a maximum. One pre-aggregated pass: a tie is counted by value first."""
    best, pick = (F.min, F.max) if kind == "min" else (F.max, F.min)
    per_value = df.groupBy(*by, measure).agg(F.count(F.lit(1)).alias("_n"), pick(ident).alias("_id"))
    known = F.col(measure).isNotNull()
    row = F.when(known, F.struct(F.col(measure).alias("v"), F.col("_id").alias("i"), F.col("_n").alias("n")))
    out = per_value.groupBy(*by).agg(best(row).alias("b"), F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("with_value"), F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("without_value"))
    return out.select(*by, F.col("b.i").alias("winner"), F.col("b.v").alias("value"), "with_value", "without_value", (F.coalesce(F.col("b.n"), F.lit(1)) - 1).alias("ties"))


def scaled(value: Column, low: Column, high: Column, higher_is_better: bool = True) -> Column:
    """0 to 100 between the bounds; 100 where both are equal; null stays null."""
    share = (value - low) / (high - low) if higher_is_better else (high - value) / (high - low)
    return F.when(value.isNull(), None).when(high == low, F.lit(100.0)).otherwise(share * 100)


def with_scales(df: DataFrame, measures: dict[str, bool]) -> DataFrame:
    """df with scaled_<measure>, between the extremes of all rows. The extremes are one row, joined to every row."""
    bounds = df.agg(*[f(m).alias(f"_{n}_{m}") for m in measures for n, f in (("lo", F.min), ("hi", F.max))])
    both = df.join(F.broadcast(bounds))  # one row
    return both.select(*df.columns, *[scaled(F.col(m).cast("double"), F.col(f"_lo_{m}").cast("double"), F.col(f"_hi_{m}").cast("double"), up).alias(f"scaled_{m}") for m, up in measures.items()])


def weighted_score(columns: dict[str, float], digits: int = 2) -> Column:
    """Weighted mean of the scaled measures that are there: a missing one leaves numerator and denominator. Rounded half
    to even; null if all are missing."""
    terms = [F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in columns.items()]
    weights = [F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in columns.items()]
    total = reduce(lambda a, b: a + b, weights)
    return F.when(total > 0, F.bround(reduce(lambda a, b: a + b, terms) / total, digits))


def nearest(df: DataFrame, by: list[str], position: str, target, cost: str, ident: str, cheapest: bool = True) -> DataFrame:
    """Per group the row whose position is nearest to the target; ties in the customer's favour (least cost, or most
    yield), then by id. min_by keeps one row a task, so a large group needs no sort."""
    price = F.col(cost) if cheapest else -F.col(cost)
    key = F.struct(F.abs(F.col(position) - target), price.isNull(), price, F.col(ident))
    rest = [c for c in df.columns if c not in by]
    return df.filter(F.col(position).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_best")).select(*by, *[F.col(f"_best.{c}").alias(c) for c in rest])


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of a page (from 1) under a total order."""
    return df.orderBy(*order).offset((max(1, page) - 1) * min(100, size)).limit(min(100, size))


def top_and_rest(df: DataFrame, label: str, count: str, n: int, rest: str = "other") -> DataFrame:
    """The n largest labels and one row for the others. Only the n names are kept apart: a top-k, not a global sort."""
    top = df.orderBy(F.col(count).desc(), F.col(label)).limit(n).select(F.col(label).alias("_top"))
    named = df.join(F.broadcast(top), F.col(label) == F.col("_top"), "left")  # n rows
    return named.groupBy(F.coalesce("_top", F.lit(rest)).alias(label)).agg(F.sum(count).alias(count))


def hash_sample(df: DataFrame, key: list[str], strata: list[str], per_stratum: int, seed: int = 1) -> DataFrame:
    """The `per_stratum` rows of each stratum with the smallest hash of the key: the same whenever it runs."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_stratum).drop("_place")
