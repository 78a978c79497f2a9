"""Mixing sources to target weights by balanced sampling with the cube method.

The words to take of a source are its share of the mix, at most `most_repeats` times its size; the excess of such
sources is reshared among the others by weight until none is above. Every document of a source is taken floor(rate)
times, and once more with the fractional rest of the rate as inclusion probability. The cube method moves these
probabilities through the null space of the balancing constraints (documents and words stay as expected) until they are
0 or 1. The flight runs in chunks of bounded size; what a chunk leaves, two documents at most, meets the leftovers of
other chunks in the next round, so a source of any size takes log(n) rounds. The last few of a source are landed by
trying all roundings. All random choices come from hashes of the rows, so reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own, last in order. Without any words every target
is 0. Repeated rows are documents of their own. Documents of size 0 take part with 0 words.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import apart, saved

CHUNK = 4000
EPS = 1e-9


def sized(docs: DataFrame, key=None) -> DataFrame:
    """doc_id, source, size (words in the text), row_key (a hash by which reruns agree)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), *([key.alias("row_key")] if key is not None else []))
    return base if key is not None else base.withColumn("row_key", F.xxhash64("doc_id", "source", "size"))


def ranked(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources in order of code points, null last, with repeating weights. The order is a range partitioning; only a
    count per partition comes to the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    spread = saved(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sources")
    counts = dict(spread.groupBy("part").agg(F.count(F.lit(1))).collect())
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    start = F.coalesce(*[F.when(F.col("part") == p, F.lit(b)) for p, b in starts], F.lit(0)) if starts else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    place = F.pmod(start + within, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    return spread.withColumn("weight", weight).drop("part")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_repeats: float) -> DataFrame:
    """sources (source, source_size) with target. Each round fixes the sources that reached their limit and shares the
    rest anew; three sums a round come to the driver. A source of size 0 is at its limit at once."""
    table = saved(ranked(sources, weights), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, left = 0.0, share * total
    limit = F.col("source_size") * most_repeats
    fixed_before = -1
    while True:
        above = (F.col("weight") * F.lit(level) >= limit) if level else F.col("source_size") == 0
        s = table.agg(F.sum(F.when(above, limit)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("free"), F.count(F.when(above, 1)).alias("n")).first()
        if not s["free"] or s["n"] == fixed_before:
            break
        fixed_before = s["n"]
        level = max(level, (left - float(s["full"] or 0)) / float(s["free"]))
    return table.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level)))).drop("weight")


def flight(p: np.ndarray, size: np.ndarray, draws: np.random.Generator, land: bool) -> np.ndarray:
    """Moves p until at most two entries are fractional (none if `land`), keeping sum(p) and sum(p * size)."""
    p = p.astype(float).copy()
    todo = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    active: list[int] = []
    while True:
        while len(active) < 3 and (k := next(todo, None)) is not None:
            active.append(k)
        if len(active) < 3:
            break
        i, j, k = active
        a, b, c = size[i], size[j], size[k]
        u = (c - b, a - c, b - a)  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(active, u, strict=True) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(active, u, strict=True) if v)
        step = up if draws.random() * (up + down) < down else -down
        for x, v in zip(active, u, strict=True):
            p[x] += step * v
            if p[x] < EPS:
                p[x] = 0.0
            elif p[x] > 1 - EPS:
                p[x] = 1.0
        active = [x for x in active if 0 < p[x] < 1]
    if land and active:
        words, docs = sum(p[x] * size[x] for x in active), sum(p[x] for x in active)
        choice = min(itertools.product((0.0, 1.0), repeat=len(active)), key=lambda c: (abs(sum(y * size[x] for x, y in zip(active, c, strict=True)) - words), abs(sum(c) - docs)))
        for x, y in zip(active, choice, strict=True):
            p[x] = y
    return p


def cube(units: DataFrame, group: str, seed: int) -> DataFrame:
    """units with columns `group`, row_key, size, p -> the same with p 0 or 1, balanced per group on count and size."""
    schema = units.schema

    def run(land: bool):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "row_key"], ascending=[False, True], kind="stable").reset_index(drop=True)  # small documents are left for the landing
            draws = np.random.default_rng([seed, int(pdf["row_key"].min()) & 0x7FFFFFFFFFFFFFFF, len(pdf)])
            return pdf.assign(p=flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), draws, land))

        return one

    whole = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
    done, units, turn = units.filter(whole), units.filter(~whole), 0
    while True:
        sizes = units.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
        most = sizes.agg(F.max("_n")).first()[0] or 0
        if not most:
            return done
        last = most <= CHUNK
        if last:
            return done.unionByName(units.groupBy(group).applyInPandas(run(True), schema))
        chunk = F.pmod(F.xxhash64("row_key", F.lit(seed + turn)), F.ceil(F.col("_n") / CHUNK))
        dealt = units.join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).withColumn("_chunk", chunk).drop("_g", "_n")

        move = run(False)

        def part(pdf: pd.DataFrame) -> pd.DataFrame:  # one argument: a second would be taken for the key
            return move(pdf.drop(columns="_chunk"))

        moved = saved(dealt.groupBy(group, "_chunk").applyInPandas(part, schema), "flight")
        done, units, turn = done.unionByName(moved.filter(whole)), moved.filter(~whole), turn + 1


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as often as the mix takes them, 0 to 2 times with the default options. Rows with equal id, source and text
    are told apart by nothing here and share their copies; other columns may have any name."""
    packed, back = apart(docs, "doc_id", "source", "text")
    key = F.xxhash64("doc_id", "source", "text")
    chosen = mix(sized(docs, key), **options).groupBy("row_key").agg(F.sum("copies").cast("int").alias("_copies")).filter("_copies > 0").withColumnRenamed("row_key", "_key")
    keyed = packed.withColumn("_key", key).dropDuplicates(["_key"])
    return keyed.join(chosen, "_key").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*back)


def mix(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most_repeats: float = 2.0, seed: int = 7) -> DataFrame:
    """sizes (doc_id, source, size, row_key) with source_size, target and taken."""
    sizes = saved(sizes, "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, share, most_repeats).withColumnRenamed("source", "_s")
    rated = sizes.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most_repeats), F.col("target") / F.col("source_size"))).otherwise(0.0)
    base = F.floor(rate + EPS)
    units = rated.withColumns({"base": base.cast("long"), "p": F.greatest(F.lit(0.0), rate - base)})
    chosen = cube(saved(units, "units"), "source", seed)
    return chosen.withColumn("copies", F.col("base") + F.round("p").cast("long")).withColumn("taken", F.col("size") * F.col("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "size", "source_size", "target", "taken")
