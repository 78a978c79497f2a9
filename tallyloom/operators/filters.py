"""Hard filters that say why a row was rejected, relaxation hints, canonical URLs and keyed deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "yclid", "msclkid", "mc_cid", "mc_eid", "_ga", "ref")


def gate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with `reason`: the name of the first rule (in order) that is false; where a rule is unknown because its value
    is missing, the name with `:no_data`. Kept rows have a null reason."""
    reason = None
    for name, rule in rules:
        for test, text in ((rule.isNull(), f"{name}:no_data"), (~rule, name)):
            reason = F.when(test, text) if reason is None else reason.when(test, text)
    return df.withColumn("reason", reason if reason is not None else F.lit(None).cast("string"))


def gate_report(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def relaxation_hints(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """dropped, survivors: how many rows pass if one rule is dropped. One pass over df for all rules."""
    passes = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules}
    flags = df.select(*[p.alias(f"_{n}") for n, p in passes.items()])
    counts = [F.sum(reduce(lambda a, b: a & b, [F.col(f"_{m}") for m in passes if m != n], F.lit(True)).cast("long")).alias(n) for n in passes]
    wide = flags.agg(*counts)
    stacked = ", ".join(f"'{n}', `{n}`" for n in passes)
    return wide.selectExpr(f"stack({len(passes)}, {stacked}) as (dropped, survivors)")


def canonical_url(url: Column) -> Column:
    """https, no www, no fragment, no closing slash, no tracking parameters, the others sorted."""
    parts = lambda g: F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", g)
    host = F.regexp_replace(F.lower(parts(1)), r"^www\.", "")
    path = F.regexp_replace(parts(2), "/+$", "")
    query = F.filter(F.split(parts(3), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    joined = F.array_join(F.array_sort(query), "&")
    return F.when(host != "", F.concat(F.lit("https://"), host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def same_site(url: Column, host: str) -> Column:
    """A relative address belongs to the site as well."""
    own = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    return (own == "") | (own == host.lower().removeprefix("www."))


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. min_by keeps one row per key and task before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicates_by_hash(df: DataFrame, text: Column, ident: str) -> DataFrame:
    """content_hash, n, first_id of the texts that occur more than once after white space and case are evened out."""
    return df.select(F.sha2(text, 256).alias("content_hash"), ident).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first_id")).filter("n > 1")
