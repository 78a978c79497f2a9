"""Evaluation: derived rates, macro means with a support floor, reference rounds, agreement of rounds, run counters, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """0 where there is nothing to share."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def derived(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn, tn) with support, precision, recall, f1, hallucination (found though wrong) and silence (rightly
    nothing found)."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"support": tp + fn, "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "hallucination": share(fp, tp + fp), "silence": share(tn, tn + fp)})


def macro_f1(per_field: DataFrame, least_support: int = 5) -> DataFrame:
    """One row: mean f1 over the fields with enough support, how many they are and how many were left out."""
    enough = F.col("support") >= least_support
    return per_field.agg(F.avg(F.when(enough, F.col("f1"))).alias("macro_f1"), F.count_if(enough).alias("fields"), F.count_if(~enough).alias("left_out"))


def reference_round(labels: DataFrame, annotator: str = "annotator") -> DataFrame:
    """One row: the annotator with most labels, the smaller name on ties."""
    return labels.groupBy(annotator).agg(F.count(F.lit(1)).alias("n_labels")).orderBy(F.col("n_labels").desc(), annotator).limit(1)


def paired_rounds(labels: DataFrame, key: list[str], value: str, evidence: str, annotator: str = "annotator") -> DataFrame:
    """The labels of every other round beside the reference round's label of the same key: same_value, same_evidence."""
    first = reference_round(labels, annotator).select(F.col(annotator).alias("reference"))
    marked = labels.crossJoin(F.broadcast(first))  # one row
    ours = marked.filter(F.col(annotator) == F.col("reference")).select(*key, "reference", F.col(value).alias("_value"), F.col(evidence).alias("_evidence"))
    others = marked.filter(F.col(annotator) != F.col("reference")).drop("reference")
    even = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return others.join(ours, key).select(*key, "reference", annotator, (even(value) == even("_value")).alias("same_value"), (even(evidence) == even("_evidence")).alias("same_evidence"))


def agreement(pairs: DataFrame, campaign: str, annotator: str = "annotator", copied_from: int = 20) -> DataFrame:
    """Per other round: shared labels, campaigns, agreeing labels, their share, and whether it looks copied (all evidence
    of at least `copied_from` labels is the same)."""
    out = pairs.groupBy("reference", annotator).agg(F.count(F.lit(1)).alias("shared"), F.count_distinct(campaign).alias("campaigns"), F.count_if("same_value").alias("agreeing"), F.count_if("same_evidence").alias("_same"))
    return out.withColumns({"agreement": share(F.col("agreeing"), F.col("shared")), "copied": (F.col("shared") >= copied_from) & (F.col("_same") == F.col("shared"))}).drop("_same")


def disagreements(pairs: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The n fields that rounds disagree on most."""
    return pairs.filter(~F.col("same_value")).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), name).limit(n)


def run_counters(facts: DataFrame, campaign: str, rejected: str = "rejected_reason", conflict: str = "conflict") -> DataFrame:
    """counter, n: processed campaigns, extracted facts, conflicts, and a row per reason of rejection."""
    total = facts.agg(F.count_distinct(campaign).alias("processed"), F.count_if(F.col(rejected).isNull()).alias("extracted"), F.count_if(conflict).alias("conflicts"))
    names = ("processed", "extracted", "conflicts")
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in names])).alias("r")).select("r.*")
    reasons = facts.filter(F.col(rejected).isNotNull()).groupBy(F.concat(F.lit("rejected:"), rejected).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(reasons)


def markdown(df: DataFrame, title: str, order: list, rows: int = 200) -> str:
    """A report as a Markdown table: the first `rows` rows under the order, and a note if there are more."""
    found = df.orderBy(*order).limit(rows + 1).collect()  # bounded by `rows`
    cell = lambda v: "—" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in found[:rows]]
    return "\n".join([*lines, *(["", f"More than {rows} rows."] if len(found) > rows else [])]) + "\n"


def gap_of_methods(counts: DataFrame, method: str = "method", blind: str = "blind", assisted: str = "assisted") -> DataFrame:
    """One row: F1 of blind and of assisted labels from counts (tp, fp, fn, tn by method), and how much better the assisted ones look.
    Null where a method has no labels."""
    f1 = derived(counts.groupBy(method).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))
    of = lambda name: F.max(F.when(F.col(method) == name, F.col("f1")))
    both = f1.agg(of(blind).alias("blind_f1"), of(assisted).alias("assisted_f1"))
    return both.withColumn("gap", F.col("assisted_f1") - F.col("blind_f1"))
