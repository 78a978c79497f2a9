"""Facts with provenance: merging, pivoting to metrics, labels, status, upserts, matching keys, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extraction methods from most to least trusted.
METHODS = ("table", "rule", "llm")


def status_of(start: Column, end: Column, today: Column) -> Column:
    """unknown without dates; expired, upcoming or active else."""
    return F.when(start.isNull() & end.isNull(), "unknown").when(end < today, "expired").when(start > today, "upcoming").otherwise("active")


def period_reason(start: Column, end: Column, today: Column, least_year: int = 2020) -> Column:
    """Why a period makes no sense, or null."""
    return (
        F.when(start > end, "reversed")
        .when(F.year(end) < least_year, "end_before_min_year")
        .when(end < today, "end_in_past")
        .when(end > F.add_months(today, 36), "end_too_far")
        .when(end.isNull() & (F.year(start) < least_year), "start_before_min_year")
    )


def priority(method: Column, order: tuple[str, ...] = METHODS) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), method), F.lit(0)), F.lit(len(order) + 1))


def merge_facts(facts: DataFrame, key: list[str], value: str = "value", method: str = "method", confidence: str = "confidence", order: tuple[str, ...] = METHODS) -> DataFrame:
    """Per key the fact of the most trusted method, then of the highest confidence; `conflict` if another value was
    found, at the price of 0.15 confidence (0.10 at least)."""
    rank = F.struct(-priority(F.col(method), order), F.col(confidence), F.col(value))
    out = facts.groupBy(*key).agg(F.max_by(F.struct(value, method, confidence), rank).alias("w"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("n_facts"))
    conflict = ~F.col("_lo").eqNullSafe(F.col("_hi"))
    sure = F.col(f"w.{confidence}")
    return out.select(*key, F.col(f"w.{value}").alias(value), F.col(f"w.{method}").alias(method), F.when(conflict, F.greatest(F.lit(0.10), sure - 0.15)).otherwise(sure).alias(confidence), conflict.alias("conflict"), "n_facts")


def to_metrics(facts: DataFrame, key: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """Tall facts as one row per key with a column per field (a fixed list); absent is null."""
    return facts.groupBy(key).pivot(field, fields).agg(F.max(value))


def best_labels(labels: DataFrame, key: list[str], value: str, confidence: str) -> DataFrame:
    """Per key the value with the highest confidence, the smaller value on ties."""
    return labels.groupBy(*key).agg(F.min_by(value, F.struct(-F.col(confidence), F.col(value))).alias(value), F.max(confidence).alias(confidence))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new put in their place or added; columns that new lacks keep their old values."""
    b = new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns], F.lit(True).alias("_here"))
    on = None
    for c in key:
        same = F.col(c).eqNullSafe(F.col(f"_new_{c}"))
        on = same if on is None else on & same
    joined = old.withColumn("_was", F.lit(True)).join(b, on, "full")
    return joined.select(*[F.when(F.col("_here"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key old has not, one a key."""
    return new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti")


def change_status(old: DataFrame, new: DataFrame, key: list[str], content: str) -> DataFrame:
    """new with change: new, updated or unchanged by the hash of the content."""
    known = old.select(*key, F.sha2(content, 256).alias("_old"), F.lit(True).alias("_known")).join(new.select(*key).distinct(), key, "left_semi")
    joined = new.join(known, key, "left")
    return joined.withColumn("change", F.when(F.col("_known").isNull(), "new").when(F.col("_old").eqNullSafe(F.sha2(content, 256)), "unchanged").otherwise("updated")).drop("_old", "_known")


def suffix_match(keys: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """wanted keys with the only existing key that equals them up to a version suffix (-3, _1); ambiguous ones stay null."""
    base = lambda c: F.regexp_replace(c, r"[-_]\d+$", "")
    unique = keys.select(F.col(column).alias("match"), base(F.col(column)).alias("_base")).groupBy("_base").agg(F.count(F.lit(1)).alias("_n"), F.min("match").alias("match")).filter("_n = 1")
    return wanted.withColumn("_base", base(F.col(column))).join(unique.drop("_n"), "_base", "left").drop("_base")


def values_match(gold: Column, found: Column, unit: Column) -> Column:
    """Equality by unit: percents within 0.01, numbers as numbers, flags by synonyms, else text without case."""
    a, b = gold.try_cast("double"), found.try_cast("double")
    flag = lambda c: F.when(F.lower(c).isin("true", "1", "evet", "yes"), True).when(F.lower(c).isin("false", "0", "hayır", "no"), False)
    return F.coalesce(
        F.when(unit == "pct", F.abs(a - b) <= 0.01 + 1e-12).when(unit.isin("try", "month", "count", "number"), a == b).when(unit == "bool", flag(gold) == flag(found)).otherwise(F.lower(F.trim(gold)) == F.lower(F.trim(found))),
        F.lit(False),
    )


def confusion(pairs: DataFrame, gold: str, found: str, same: Column, groupings: list[list[str]]) -> DataFrame:
    """tp, fp, fn, tn over several groupings at once. A wrong value counts as fp and as fn; silence about an absent value is
    a tn. Columns that a row doesn't group by are null."""
    has, says = F.col(gold).isNotNull(), F.col(found).isNotNull()
    counts = {"tp": has & says & same, "fp": says & ~(has & same), "fn": has & ~(says & same), "tn": ~has & ~says}
    flagged = pairs.withColumns({k: F.coalesce(v, F.lit(False)).cast("long") for k, v in counts.items()})
    columns = sorted({c for g in groupings for c in g})
    return flagged.groupingSets([[F.col(c) for c in g] for g in groupings], *columns).agg(*[F.sum(k).alias(k) for k in counts])


def quality(c: DataFrame) -> DataFrame:
    """Precision, recall, F1, hallucination rate fp/(tp+fp) and correct silence tn/(tn+fp); 0 where undefined."""
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "hallucination": div(fp, tp + fp), "silence": div(tn, tn + fp)})


def key_audit(df: DataFrame, key: list[str], parent: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """One row: rows, distinct keys, repeated keys, orphans (rows without a parent)."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"))
    if parent is None:
        return out.withColumn("n_orphans", F.lit(0).cast("long"))
    orphans = df.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(parent_key) == F.col("_p"), "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    return out.join(F.broadcast(orphans))  # one row each
