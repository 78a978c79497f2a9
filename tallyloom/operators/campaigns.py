"""Lists of campaigns: filters, search order, pages with totals, children, nested rates, corpus rows, caps, guarded deletes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of search results with equal scores.
STATUSES = ("active", "unknown", "upcoming", "expired")
#: Least confidence of a field that a card shows.
CARD_CONFIDENCE = 0.60


@dataclass(frozen=True)
class Wanted:
    """What a list asks for; empty members ask for nothing. Children and expired campaigns are left out unless asked for."""

    within: dict[str, Sequence] = field(default_factory=dict)
    equal: dict[str, object] = field(default_factory=dict)
    status: str | None = None
    search: str = ""
    start_after: str | None = None
    end_before: str | None = None
    with_children: bool = False
    with_expired: bool = False


def campaign_filter(df: DataFrame, wanted: Wanted, parent: str = "parent_id", status: str = "status", texts: Sequence[str] = ("title", "description"), start: str = "start_date", end: str = "end_date") -> DataFrame:
    """One conjunction, so that the parts over stored columns reach the scan. The search is a substring of any text, in
    upper or lower case; a null text holds nothing, and a null date is in no bounds."""
    tests = [F.col(c).isin(*values) for c, values in wanted.within.items() if values]
    tests += [F.col(c) == value for c, value in wanted.equal.items() if value is not None]
    if not wanted.with_children:
        tests.append(F.col(parent).isNull())
    if wanted.status:
        tests.append(F.col(status) == wanted.status)
    elif not wanted.with_expired:
        tests.append(F.col(status) != "expired")
    if needle := wanted.search.strip():
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lower(F.lit(needle))), F.lit(False)) for c in texts]))
    if wanted.start_after:
        tests.append(F.col(start) >= F.lit(wanted.start_after).cast("date"))
    if wanted.end_before:
        tests.append(F.col(end) <= F.lit(wanted.end_before).cast("date"))
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def with_all_labels(df: DataFrame, labels: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """df's rows that bear every wanted label (axis, value): one aggregation and one semi join for any number of axes."""
    if not wanted:
        return df
    any_of = reduce(lambda a, b: a | b, [(F.col("axis") == a) & (F.col("value") == v) for a, v in wanted.items()])
    bearers = labels.filter(any_of).groupBy(key).agg(F.count_distinct("axis").alias("_n")).filter(F.col("_n") == len(wanted))
    return df.join(bearers.select(key), key, "left_semi")


def search_order(score: str, status: str, ident: str) -> list[Column]:
    """Best score first, then active, unknown, upcoming, expired and any other, then the smaller id."""
    place = reduce(lambda c, s: c.when(F.col(status) == s[1], s[0]), list(enumerate(STATUSES))[1:], F.when(F.col(status) == STATUSES[0], 0)).otherwise(len(STATUSES))
    return [F.col(score).desc_nulls_last(), place, F.col(ident)]


def paged(df: DataFrame, order: list[Column], page: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """The rows of a page (from 1, of `most` rows at most) under a total order, with total and total_pages of the whole list."""
    size = max(1, min(most, size))
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    rows = df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))  # one row beside a page


def with_children(df: DataFrame, ident: str, parent: str, fields: Sequence[str]) -> DataFrame:
    """The roots with `children`, structs of the fields ordered by id; empty for roots without any."""
    nested = df.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(ident, *fields))).alias("children"))
    roots = df.filter(F.col(parent).isNull())
    joined = roots.join(nested, F.col(ident) == F.col("_parent"), "left").drop("_parent")
    kind = nested.schema["children"].dataType.simpleString()
    return joined.withColumn("children", F.coalesce("children", F.array().cast(kind)))


def only_rates(rates: str, kind: str, wanted: str | None) -> Column:
    """The nested rates of one kind, or all."""
    return F.col(rates) if wanted is None else F.filter(rates, lambda r: r[kind] == wanted)


def with_source(df: DataFrame, sources: DataFrame, key: str, wanted: str) -> DataFrame:
    """df with a column of its source row, null where there is none; a repeated source id gives no second row."""
    return df.join(sources.groupBy(key).agg(F.min(wanted).alias(wanted)), key, "left")


def card_fields(facts: DataFrame, key: str, name: str = "field", value: str = "value", confidence: str = "confidence", least: float = CARD_CONFIDENCE) -> DataFrame:
    """Per key and field the surest value that was validated, not rejected and sure enough; the smaller value on ties."""
    good = F.col("rejected_reason").isNull() & F.col("is_validated") & (F.col(confidence) >= least) & F.col(value).isNotNull()
    best = F.min_by(value, F.struct(-F.col(confidence), F.col(value)))
    return facts.filter(good).groupBy(key, name).agg(best.alias(value), F.max(confidence).alias(confidence))


def label_facts(labels: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Labels as facts: per key and axis (fields maps a field to its axis) the surest, by method `table`."""
    axis = F.create_map(*[F.lit(x) for f, a in fields.items() for x in (a, f)])
    rank = F.struct(-F.coalesce(F.col("confidence"), F.lit(1.0)), F.col("value"))
    best = labels.filter(F.col("axis").isin(*fields.values())).groupBy(key, "axis").agg(F.min_by(F.struct("value", "evidence", F.coalesce("confidence", F.lit(1.0)).alias("confidence")), rank).alias("b"))
    return best.select(key, axis[F.col("axis")].alias("field"), F.col("b.value").alias("value"), F.coalesce("b.evidence", F.lit("")).alias("evidence"), F.col("b.confidence").alias("confidence"), F.lit("table").alias("method"))


def corpus(campaigns: DataFrame, banks: DataFrame, cards: DataFrame, metrics: DataFrame, labels: DataFrame, key: str, bank: str) -> DataFrame:
    """Every campaign of a known bank with its card_text, metrics (null where absent) and `labels`, axis to values in order.
    `included` is false where there is no card; search takes the others, corpus_counts() reports both."""
    per_axis = labels.groupBy(key, "axis").agg(F.array_sort(F.collect_set("value")).alias("values"))
    tags = per_axis.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "values")))).alias("labels"))
    whole = campaigns.join(banks, bank).join(cards, key, "left").join(metrics, key, "left").join(tags, key, "left")
    return whole.withColumn("included", F.trim(F.coalesce("card_text", F.lit(""))) != "")


def corpus_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))


def widest_limits(options: DataFrame, key: str, lows: Sequence[str], highs: Sequence[str]) -> DataFrame:
    """The options of a product as one limit: the least of the lower and the largest of the upper bounds."""
    return options.groupBy(key).agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])


def with_caps(products: DataFrame, limits: DataFrame, key: str, replaced: Sequence[str], filled: Sequence[str], source: str = "limits_source", better: str = "html_attr", weaker: Sequence[str] = ("none", "text")) -> DataFrame:
    """products with the limits put in: `replaced` columns wherever the limit is known, `filled` ones only where empty. The
    name of a weaker source is raised for each product that has a limit row."""
    given = limits.select(key, *[F.col(c).alias(f"_{c}") for c in (*replaced, *filled)], F.lit(True).alias("_given"))
    changes = {c: F.coalesce(f"_{c}", c) for c in replaced} | {c: F.coalesce(c, f"_{c}") for c in filled}
    changes[source] = F.when(F.col("_given") & F.col(source).isin(*weaker), better).otherwise(F.col(source))
    return products.join(given, key, "left").withColumns(changes).select(*products.columns)


def guarded_delete(tables: dict[str, DataFrame], doomed: DataFrame, key: str, verified: bool, kept: Sequence[str] = (), dry: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of the doomed keys, and a report: table, n_rows, n_deleted. Tables in `kept` are left
    whole. Refused unless an export was verified; a dry run gives the report and the tables as they are."""
    if not (verified or dry):
        raise PermissionError("nothing is deleted before an export was verified")
    keys = doomed.select(key).distinct()
    left, report = {}, None
    for name, df in tables.items():
        safe = dry or name in kept
        left[name] = df if safe else df.join(keys, key, "left_anti")
        marked = df.select(key).join(keys.withColumn("_doomed", F.lit(True)), key, "left")
        gone = F.lit(0).cast("long") if name in kept else F.count("_doomed")
        row = marked.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), gone.alias("n_deleted"))
        report = row if report is None else report.unionByName(row)
    return left, report
