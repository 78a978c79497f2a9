"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import saved

#: Edges that a task writes at least; a step's table is never larger than the one before it.
EDGES_PER_FILE = 20_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge. Each step is a pre-aggregated minimum
    per node and a join with it, which the skew join splits at nodes of very high degree; steps end in a written table,
    and only two numbers a step come to the driver."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        if large:
            moved = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.filter("u > v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") / 2.0**32)).first())

    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    pairs = saved(pairs, "edges")
    before = state(pairs)
    while True:  # a table a round: small ones in few files
        pairs = saved(stars(stars(pairs, True), False).coalesce(max(4, before[0] // EDGES_PER_FILE)), "stars")
        after = state(pairs)
        if after[0] == before[0] and (after[1] == before[1] or after[1] is not None and abs(after[1] - before[1]) < 1e-3):
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
