"""Instalments, yields, withholding bands and legal limits. The band tables are fixed values, so they are CASE
expressions in the scan's stage, not joins."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper edge (inclusive, None is open), percent.
WITHHOLDING_TRY = ((180, 17.5), (365, 15.0), (None, 10.0))
WITHHOLDING_FX, WITHHOLDING_METAL = 25.0, 15.0
# Upper edge of the vehicle's value, percent, months.
VEHICLE = ((400_000, 70, 48), (800_000, 50, 36), (1_200_000, 30, 24), (2_000_000, 20, 12), (None, 0, None))
# Upper edge of the home's value, percent by energy class A-B, C, other.
HOME = ((5_000_000, 90, 80, 70), (7_000_000, 80, 70, 60), (10_000_000, 70, 60, 50), (20_000_000, 50, 40, 30), (None, 40, 30, 20))
HOME_MONTHS = 120


def band(value: Column, bands: tuple, column: int = 1) -> Column:
    """The entry of the first band whose upper edge is not below the value; null for a null value."""
    out = F.when(value.isNull(), None)
    for row in bands:
        out = out.when(F.lit(True) if row[0] is None else value <= row[0], F.lit(row[column]))
    return out


def withholding(currency: Column, days: Column) -> Column:
    """Percent; null for days that aren't positive."""
    code = F.upper(currency)
    return F.when(days <= 0, None).when(code.isin("USD", "EUR"), WITHHOLDING_FX).when(code.isin("XAU", "XAG"), WITHHOLDING_METAL).otherwise(band(days, WITHHOLDING_TRY))


def energy_class(raw: Column) -> Column:
    first = F.upper(F.substring(F.trim(raw), 1, 1))
    return F.when(first.isin("A", "B"), "A-B").when(first == "C", "C").otherwise("other")


def vehicle_limit(value: Column) -> tuple[Column, Column, Column]:
    """Percent, amount, months."""
    percent = band(value, VEHICLE)
    return percent, F.round(value * percent / 100, 2), band(value, VEHICLE, 2)


def home_limit(value: Column, energy: Column) -> tuple[Column, Column]:
    """Percent, amount."""
    cls = energy_class(energy)
    percent = F.when(cls == "A-B", band(value, HOME, 1)).when(cls == "C", band(value, HOME, 2)).otherwise(band(value, HOME, 3))
    return percent, F.round(value * percent / 100, 2)


def instalment(principal: Column, monthly_percent: Column, months: Column) -> Column:
    """Annuity in double arithmetic, rounded to 0.01; a rate of 0 or less divides evenly."""
    r = monthly_percent / 100.0
    growth = F.pow(1 + r, months)
    return F.round(F.when(r <= 0, principal / months).otherwise(principal * r * growth / (growth - 1)), 2)


@F.pandas_udf(T.DecimalType(20, 2))
def instalment_exact(principal: pd.Series, monthly_percent: pd.Series, months: pd.Series) -> pd.Series:
    """The same with 28 digits and half-up rounding; takes decimals. Spark's power is a double and a product of
    decimal(38,18) loses scale, so this one is an Arrow function."""

    def one(p, r, n):
        if p is None or r is None or n is None or n <= 0:
            return None
        with localcontext() as c:
            c.prec = 28
            p, r, n = Decimal(p), Decimal(r) / 100, int(n)
            growth = (1 + r) ** n
            value = p / n if r <= 0 else p * r * growth / (growth - 1)
            return value.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)

    return pd.Series([one(*x) for x in zip(principal, monthly_percent, months, strict=True)], dtype="object")


def net_yield(amount: Column, yearly_percent: Column, days: Column, currency: Column) -> tuple[Column, Column, Column]:
    """Gross yield, withheld part, net yield; each rounded to 0.01."""
    gross = F.round(amount * yearly_percent / 100.0 * days / 365.0, 2)
    tax = F.round(gross * withholding(currency, days) / 100.0, 2)
    return gross, tax, F.round(gross - tax, 2)


@F.pandas_udf(T.DoubleType())
def implied_monthly_rate(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Percent a month at which the annuity of a principal over n months sums to the total, by 80 bisections to 0.0001;
    null without a solution in 0 to 20 percent."""
    for principal, total, months in batches:
        p, t, n = (s.to_numpy(float) for s in (principal, total, months))
        low, high = p * 0, p * 0 + 0.2

        def paid(r, p=p, n=n):
            growth = (1 + r) ** n
            return p * r * growth / (growth - 1) * n

        for _ in range(80):
            mid = (low + high) / 2
            less = paid(mid) < t
            low, high = low * ~less + mid * less, high * less + mid * ~less
        out = pd.Series((low * 100).round(4))
        yield out.where((t > p) & (n > 0) & (t <= paid(p * 0 + 0.2)) & (p > 0))


def plan_rate(principal: Column, profit: Column, repayment: Column, months: Column) -> Column:
    """Monthly percent of a payment plan: from principal and profit where both are known, since the sum of instalments may
    hold fees; else from that sum."""
    return implied_monthly_rate(principal, F.coalesce(principal + profit, repayment), months)


def _known(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """product_type, term, bank, bands: array<struct<low, high, n, near>> for every asked type and term and every bank with rates of
    the type. In every band of a bank the asked terms and the rates' terms stand in one order, and each asked one has the last
    rate before it and the next one after."""
    band = ["bank", "product_type", "low", "high"]
    priced = rates.filter(F.col("rate").isNotNull())
    bands = priced.groupBy(*band).agg(F.count(F.lit(1)).alias("n"))
    best = priced.filter(F.col("term").isNotNull()).groupBy(*band, "term").agg(F.min(F.struct("rate", "product", F.col("term").alias("at"))).alias("r"))
    asked = requests.select("product_type", "term").distinct().join(bands, "product_type")
    merged = asked.select(*band, "term", "n", F.lit(None).cast(best.schema["r"].dataType).alias("r"), F.lit(True).alias("ask")).unionByName(best.select(*band, "term", F.lit(None).cast("long").alias("n"), "r", F.lit(False).alias("ask")))
    line = Window.partitionBy(*band).orderBy("term")  # as many rows as there are terms
    up_to, after = line.rangeBetween(Window.unboundedPreceding, 0), line.rangeBetween(0, Window.unboundedFollowing)
    sides = merged.withColumns({"a": F.last("r", True).over(up_to), "b": F.first("r", True).over(after)}).filter("ask")
    away = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.abs(F.col(f"{r}.at") - F.col("term")).alias("away"), F.col(f"{r}.rate").alias("rate"), F.col(f"{r}.product").alias("product"), F.col(f"{r}.at").alias("at")))
    return sides.withColumn("near", F.least(away("a"), away("b"))).groupBy("product_type", "term", "bank").agg(F.collect_list(F.struct("low", "high", "n", "near")).alias("bands"))


def _met(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests with _banks: array<struct<bank, near, in_band>>: of each bank's bands those that hold the amount. A request meets the
    one row of its type and term, and stays one row."""
    one = known.groupBy("product_type", "term").agg(F.array_sort(F.collect_list(F.struct("bank", "bands"))).alias("_all")).select(F.col("product_type").alias("_type"), F.col("term").alias("_term"), "_all")
    amount = F.col("amount")
    holds = lambda x: (x["low"].isNull() | (amount >= x["low"])) & (x["high"].isNull() | (amount <= x["high"]))
    held = requests.join(one, F.col("product_type").eqNullSafe(F.col("_type")) & F.col("term").eqNullSafe(F.col("_term")))
    held = held.withColumn("_held", F.transform("_all", lambda b: F.struct(b["bank"].alias("bank"), F.filter(b["bands"], holds).alias("bands")))).drop("_all", "_type", "_term")
    in_band = lambda b: F.when(F.size(b["bands"]) > 0, F.aggregate(b["bands"], F.lit(0).cast("long"), lambda n, x: n + x["n"]))
    return held.withColumn("_banks", F.transform("_held", lambda b: F.struct(b["bank"].alias("bank"), F.array_min(F.transform(b["bands"], lambda x: x["near"])).alias("near"), in_band(b).alias("in_band")))).drop("_held")


def nearest_rates(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """request, amount, term, bank, product, rate, rate_term, in_band (rates of the bank whose band holds the amount) of every
    request (request, product_type, amount, term) and every bank that has rates (bank, product, product_type, term, rate, low,
    high) of its product type in that band. The rate is that of the nearest term; of equally near ones the lowest, then the
    smallest product. Requests differ by amount and term only, so terms are looked up once each."""
    met = _met(requests, _known(requests, rates)).select("request", "amount", "term", F.inline("_banks")).filter("in_band is not null")
    return met.select("request", "amount", "term", "bank", "near.product", "near.rate", F.col("near.at").alias("rate_term"), "in_band")


#: Why a bank makes no offer: fixed values.
NO_RATE, NO_TERM = "no_published_rate", "rates_do_not_cover_the_term"


def financing_offers(requests: DataFrame, rates: DataFrame, banks: DataFrame) -> DataFrame:
    """request, bank, product, rate, rate_term, is_exact, monthly, total, profit, is_best, missing: one row for every request and
    bank. A bank without a rate that fits says why. A rate of 0 is a rate. The offer with the least total is the best, of equal
    ones that of the first bank."""
    known = _known(requests, rates)
    every = requests.select("product_type", "term").distinct().join(F.broadcast(banks.select("bank")))  # the banks are few, and each is a row of the answer
    own = known.select(*[F.col(c).alias(f"_{c}") for c in ("product_type", "term", "bank")], "bands")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("product_type", "term", "bank")])
    whole = every.join(own, same, "left").select("product_type", "term", "bank", F.coalesce("bands", F.array().cast(known.schema["bands"].dataType)).alias("bands"))
    asked, months = F.col("amount").cast("double"), F.col("term")
    near = lambda b, field: b["near"][field]
    monthly = lambda b: F.when(near(b, "rate").isNotNull(), instalment(asked, near(b, "rate").cast("double"), months))
    offers = _met(requests, whole).withColumn("_banks", F.transform("_banks", lambda b: F.struct(b["bank"].alias("bank"), b["near"].alias("near"), b["in_band"].alias("in_band"), monthly(b).alias("monthly"))))
    offers = offers.withColumn("_banks", F.transform("_banks", lambda b: b.withField("total", F.round(b["monthly"] * months, 2))))
    offers = offers.withColumn("_best", F.array_min(F.filter(F.transform("_banks", lambda b: F.struct(b["total"].alias("total"), b["bank"].alias("bank"))), lambda b: b["total"].isNotNull())))
    rate, rate_term = F.col("near.rate"), F.col("near.at")
    missing = F.when(F.col("in_band").isNull(), NO_RATE).when(rate.isNull(), NO_TERM)
    return offers.select("request", "amount", "term", "_best", F.inline("_banks")).select(
        "request", "bank", "near.product", rate.alias("rate"), rate_term.alias("rate_term"), F.when(rate.isNotNull(), rate_term == months).alias("is_exact"), "monthly", "total",
        F.round(F.col("total") - F.col("amount"), 2).alias("profit"), F.when(rate.isNotNull(), F.col("bank") == F.col("_best.bank")).alias("is_best"), missing.alias("missing"),
    )
