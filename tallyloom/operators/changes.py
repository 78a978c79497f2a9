"""Changes of stored tables as new versions of them: replace, expire, retire, annotate, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.operators.facts import upsert


def replace_stale(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """old without the rows of any scope (product, source, kind of rate ...) that new has rows of, and new."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new, allowMissingColumns=True)


def expire(table: DataFrame, gone: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """table with the status `expired` for the keys in gone; nothing is deleted."""
    marks = gone.select(*key).distinct().withColumn("_gone", F.lit(True))
    return table.join(marks, key, "left").withColumn(status, F.when(F.col("_gone"), "expired").otherwise(F.col(status))).drop("_gone").select(*table.columns)


def retire(table: DataFrame, key: str, scope: DataFrame, children: DataFrame) -> DataFrame:
    """table with fate: `kept` (in scope), `retired`, or `has_children` (out of scope, but something still points to it)."""
    inside = scope.select(key).distinct().withColumn("_in", F.lit(True))
    used = children.select(key).distinct().withColumn("_used", F.lit(True))
    fate = F.when(F.col("_in"), "kept").when(F.col("_used"), "has_children").otherwise("retired")
    return table.join(inside, key, "left").join(used, key, "left").withColumn("fate", fate).drop("_in", "_used")


AUTO = "auto_evidence"


def annotate(old: DataFrame, new: DataFrame, fields: tuple[str, ...], methods: tuple[str, ...] = ("blind", "assisted")) -> tuple[DataFrame, DataFrame]:
    """The annotations (campaign_key, field, annotator, value, evidence, method, note) after an upsert, and the rejected rows
    with a reason. Dates become ISO; the mark of automatic evidence stays only where the evidence is unchanged."""
    key = ["campaign_key", "field", "annotator"]
    reason = F.when(~F.coalesce(F.col("field").isin(*fields), F.lit(False)), "unknown_field").when(~F.coalesce(F.col("method").isin(*methods), F.lit(False)), "unknown_method")
    judged = new.withColumn("reason", reason)
    iso = F.when(F.col("field").endswith("_date"), F.coalesce(F.date_format(parse.date_tr(F.col("value")), "yyyy-MM-dd"), F.col("value"))).otherwise(F.col("value"))
    good = judged.filter("reason is null").drop("reason").withColumn("value", iso)
    before = old.select(*key, F.col("evidence").alias("_e"), F.col("note").alias("_n"))
    kept = (F.col("_n") == AUTO) & F.col("_e").eqNullSafe(F.col("evidence"))
    good = good.join(before, key, "left").withColumn("note", F.when(kept, AUTO).when(F.col("note") == AUTO, None).otherwise(F.col("note"))).drop("_e", "_n")
    return upsert(old, good.select(*old.columns), key), judged.filter("reason is not null")


def split_variants(rates: DataFrame, product: str, variant: str) -> DataFrame:
    """rates with child and parent: products whose rates name two variants or more get a child a variant; rates without a
    variant stay with the parent."""
    n = F.size(F.collect_set(variant).over(Window.partitionBy(product)))
    child = F.when((n >= 2) & F.col(variant).isNotNull(), F.concat_ws("#", product, F.regexp_replace(F.lower(variant), "[^a-z0-9]+", "-")))
    return rates.withColumns({"child": F.coalesce(child, F.col(product)), "parent": F.when(child.isNotNull(), F.col(product))})


def combinations(options: Column) -> Column:
    """The product of the numbers of options of a form's controls (an array of counts); empty controls count once."""
    return F.aggregate(options, F.lit(1).cast("long"), lambda n, k: n * F.greatest(k.cast("long"), F.lit(1).cast("long")))


def sampling_plan(n: Column, full: int = 60, grid: int = 2000) -> Column:
    return F.when(n <= full, "full").when(n <= grid, "grid").otherwise("pilot")
