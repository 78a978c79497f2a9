"""Sums of values that a large table has by key, over rows that hold many keys each: the commonest keys are looked up in a
broadcast of bounded size while the rows are made, the others are joined."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task counts before it hands its counts on, and bytes of the rows that they come from.
HELD, HELD_BYTES = 200_000, 64 << 20


def counted(keys_of_rows: Iterator[tuple[Iterable, int]]) -> Iterator[tuple]:
    """(key, how often it came) in parts from (keys, bytes) of rows: a part ends at HELD keys or HELD_BYTES, so memory is
    bounded and most of the sum is done before the shuffle."""
    held: Counter = Counter()
    weight = 0
    for keys, size in keys_of_rows:
        held.update(keys)
        weight += size
        if len(held) >= HELD or weight >= HELD_BYTES:
            yield from held.items()
            held, weight = Counter(), 0
    yield from held.items()


def commonest(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, `most` at most. A histogram over eighths of octaves gives the count from which on
    all are taken; about 500 numbers come to the driver, whatever the table's size."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 8).cast("int")
    taken, least = 0, None
    for bucket, n in sorted(table.filter(F.col(count) > 0).groupBy(step.alias("k")).agg(F.count(F.lit(1))).collect(), reverse=True):
        if taken + n > most:
            break
        taken, least = taken + n, bucket
    return table.filter(F.lit(False) if least is None else (F.col(count) > 0) & (step >= least))


def with_rest(rows: DataFrame, values: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """rows (with a number `row` that was written, the columns `sums`, and arrays rest_keys and rest_n) with n times the values of the same
    names in `values`, by key, added to `sums`. Keys that are left are rare by choice, and the skew join splits one
    that is not; what is added is summed per row in the shuffle that brings it back."""
    pairs = rows.filter(F.size("rest_keys") > 0).select("row", F.explode(F.arrays_zip("rest_keys", "rest_n")).alias("e")).select("row", F.col("e.rest_keys").alias(key), F.col("e.rest_n").alias("_n"))
    found = pairs.join(values.select(key, *sums), key)
    more = found.groupBy("row").agg(*[F.sum(F.col(s) * F.col("_n")).alias(s) for s in sums])
    others = [c for c in rows.columns if c not in ("row", "rest_keys", "rest_n", *sums)]
    both = rows.select("row", *others, *sums).unionByName(more, allowMissingColumns=True)
    return both.groupBy("row").agg(*[F.max(c).alias(c) for c in others], *[F.sum(s).alias(s) for s in sums]).drop("row")
