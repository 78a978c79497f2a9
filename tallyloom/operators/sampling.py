"""Samples with quotas, the same on every run: rows are ordered by a hash of their id and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLIND = 30


def quota_sample(df: DataFrame, ident: str, bank: str, kinds: str, hard: str, size: int = 100, per_bank: int = 6, per_kind: int = 4, least_hard: int = 35, seed: int = 42) -> DataFrame:
    """df's rows of the sample with place (1, 2, ...) and method. Quotas are filled in this order, each keeping what the ones
    before took: `per_bank` rows a bank, hard ones first; `per_kind` rows of each kind (an array column); `least_hard`
    hard rows; the rest up to `size`. If quotas take more than size, easy rows go first. The first BLIND places are
    labelled blind. Only ids and keys are ranked, never texts; what has been taken is at most a quota per group."""
    draw = F.xxhash64(ident, F.lit(seed))
    keys = df.select(F.col(ident).alias("_id"), F.col(bank).alias("_bank"), F.col(kinds).alias("_kinds"), F.coalesce(F.col(hard), F.lit(False)).alias("_hard"), draw.alias("_draw"))
    first = Window.partitionBy("_bank").orderBy(F.col("_hard").desc(), "_draw", "_id")
    taken = keys.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_bank).drop("_r")

    rest = keys.join(taken.select("_id"), "_id", "left_anti")
    have = taken.select(F.explode("_kinds").alias("_kind")).groupBy("_kind").agg(F.count(F.lit(1)).alias("_have"))
    per = Window.partitionBy("_kind").orderBy("_draw", "_id")
    more = rest.select("_id", "_draw", F.explode("_kinds").alias("_kind")).join(have, "_kind", "left").withColumn("_r", F.row_number().over(per)).filter(F.col("_r") + F.coalesce("_have", F.lit(0)) <= per_kind)
    taken = taken.unionByName(rest.join(more.select("_id").distinct(), "_id", "left_semi"))

    count = lambda t, c=F.lit(True): t.filter(c).count()
    short = least_hard - count(taken, F.col("_hard"))
    if short > 0:
        rest = keys.filter("_hard").join(taken.select("_id"), "_id", "left_anti")
        taken = taken.unionByName(rest.orderBy("_draw", "_id").limit(short))
    n = count(taken)
    if n < size:
        rest = keys.join(taken.select("_id"), "_id", "left_anti")
        taken = taken.unionByName(rest.orderBy("_draw", "_id").limit(size - n))
    kept = taken.orderBy(F.col("_hard").desc(), "_draw", "_id").limit(size)  # the sample's size bounds what is ranked below
    place = F.row_number().over(Window.orderBy(F.xxhash64("_id", F.lit(seed + 1)), "_id"))
    placed = kept.select("_id", place.alias("place")).withColumn("method", F.when(F.col("place") <= BLIND, "blind").otherwise("assisted"))
    return df.join(placed, F.col(ident) == F.col("_id")).drop("_id")


def next_unlabelled(sample: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of the sample that has no label yet."""
    return sample.join(labels.select(key).distinct(), key, "left_anti").orderBy(order).limit(1)
