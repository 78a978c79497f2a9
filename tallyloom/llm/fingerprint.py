"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its inner s-mers stands at its first or last place. That
depends on the k-mer alone, not on its neighbours, so an edit moves no anchor outside itself, and equal passages have
equal anchors at equal distances. The fingerprint lists the `keep` smallest anchor hashes of the whole text; the share
of common ones among the smallest of two fingerprints estimates the likeness (Jaccard) of their anchor sets.

Edge cases: a null text is the empty text, with an empty fingerprint; two empty fingerprints are alike (1), an empty one
and another are not (0). Texts without an anchor have one, the hash of the whole text. Documents with equal ids follow
each other in order of a hash of their texts; null ids come last. A single document is its own successor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import as_text, mixed, small_batches, with_rows

K, S, KEEP = 16, 6, 64


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (code points) of the closed syncmers of a text."""
    n = len(text)
    if n >= k:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = points[: n - s + 1].copy()
        for j in range(1, s):
            h *= np.uint64(0x100000001B3)
            h += points[j : n - s + 1 + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        width = k - s + 1
        least, have = h, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        m = n - k + 1
        at = np.flatnonzero((h[:m] == least) | (h[width - 1 : width - 1 + m] == least))
        if len(at):
            kmers = h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + width - 1]
            for j in range(s, width - 1, s):
                kmers = kmers * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
            return mixed(kmers), at
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))], np.uint64), np.zeros(1, np.int64)


def sketch(text: str, keep: int = KEEP) -> np.ndarray:
    """The smallest distinct 32-bit anchor hashes, rising."""
    h = (anchors(text)[0] >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * keep:  # the few smallest do, unless too many of them repeat
        few = np.unique(np.partition(h, 4 * keep)[: 4 * keep])
        if len(few) >= keep:
            return few[:keep]
    return np.unique(h)[:keep]


def printed(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:][both[1:] == both[:-1]]
    distinct = np.concatenate([both[:1], both[1:][both[1:] != both[:-1]]])[:keep]
    return float(np.count_nonzero(same <= distinct[-1]) / len(distinct))


def bucket(value: Column, bounds: list[int], low: int = 0) -> Column:
    """How many bounds are at most the value, as a tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value < bounds[mid], bucket(value, bounds[:mid], low)).otherwise(bucket(value, bounds[mid + 1 :], low + mid + 1))


def followed(docs: DataFrame, then, schema: pa.Schema, ddl: str) -> DataFrame:
    """Runs `then(row, next text)` for every document and its successor in falling order of doc_id. Documents are dealt
    by ranges of ids and sorted once; the first of each range is sent to the range before as well, so texts are
    shuffled once and a task holds two texts."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(x) for x in base.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)})
    base = base.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket(F.col("doc_id"), bounds)))
    # The first document of each range; as many rows as ranges.
    firsts = base.groupBy("part").agg(F.max(F.struct(F.col("doc_id"), (-F.col("tie")).alias("minus_tie"), F.col("tie"))).alias("top")).collect()
    order = sorted((r["part"] for r in firsts), reverse=True)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    copies = spark.createDataFrame([(r["part"], r["top"]["doc_id"], r["top"]["tie"], before[r["part"]]) for r in firsts], "part int, _id long, _tie long, copy_to int")
    heads = (base.part == copies.part) & base.doc_id.eqNullSafe(copies._id) & (base.tie == copies._tie)
    marked = base.join(F.broadcast(copies), heads, "left").select("doc_id", "text", "tie", base.part, "copy_to")
    places = F.array_compact(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("copy")), F.when(F.col("copy_to").isNotNull(), F.struct(F.col("copy_to").alias("p"), F.lit(1).alias("copy")))))
    rows = marked.withColumn("to", F.explode(places)).select("doc_id", "text", "tie", F.col("to.p").alias("part"), F.col("to.copy").alias("copy"))
    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "tie")

    def make(stream: Iterator[dict]) -> Iterator[tuple]:
        held = None
        for row in stream:
            if held is not None and held["part"] == row["part"] and not held["copy"]:
                yield then(held, row)
            held = row

    return ordered.mapInArrow(with_rows(make, schema), ddl)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Pairing:
    """Fingerprints of a document and its edited text; the successor's is kept for the row to come."""

    def __init__(self) -> None:
        self.text, self.sketch = None, None

    def __call__(self, row: dict, after: dict) -> tuple:
        text, later = row["text"], after["text"]
        own = self.sketch if self.text is text else sketch(text)
        self.text, self.sketch = later, sketch(later)
        n = len(text)
        half = n // 2
        edited = text[: n - half] + later[:half]
        changed = sketch(edited)
        return row["doc_id"], n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), printed(own), printed(changed), likeness(own, changed), likeness(own, self.sketch)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followed(spark.read.parquet(f"{sf_dir}/documents.parquet"), Pairing(), RESULT, RESULT_DDL)
