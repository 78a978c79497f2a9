"""Helpers that several operators share: the shared folder, written tables, Arrow batches and words."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Entries of a worker's memo of words; it is emptied when full, so memory is bounded whatever the vocabulary.
MEMO = 120_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where that is unset and the session is a
    local one (tests) a folder of this machine is made and set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="tallyloom-")
        context.setCheckpointDir(place)
        return context._jsc.sc().getCheckpointDir().get()
    return place


def fresh(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/tallyloom/{kind}-{uuid.uuid4().hex}"


#: Lists that collect the paths of the tables written while they are open; see collecting().
_collectors: list[list[str]] = []


@contextlib.contextmanager
def collecting(paths: list[str]):
    """Adds to `paths` where saved() writes inside the block, so that a caller who knows when a lazy result has been
    used can discard() its intermediate tables."""
    _collectors.append(paths)
    try:
        yield paths
    finally:
        _collectors.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables in the shared folder, whatever file system that is, and empties the list."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again. This cuts the lineage, so that a lost executor costs
    only the running stage, and the table is stored compressed by column."""
    spark = df.sparkSession
    path = fresh(spark, kind)
    if _collectors:
        _collectors[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def used_up(*tables: DataFrame) -> None:
    """Deletes tables of saved() that no later step reads."""
    for table in tables:
        discard(table.sparkSession, [table.saved_at])


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """docs with the used columns and all others in one struct, so that no name of theirs meets one that an operator gives;
    and the columns that bring back those of docs. Unused struct fields are pruned from the scan."""
    field = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in used}
    names = {c: f"`{c.replace('`', '``')}`" for c in docs.columns}
    others = F.struct(*[F.col(names[c]).alias(f) for c, f in field.items()]) if field else F.lit(None).cast("int")
    packed = docs.select(*[names[c] for c in docs.columns if c in used], others.alias("_others"))
    return packed, [F.col(f"_others.{field[c]}").alias(c) if c in field else F.col(c) for c in docs.columns]


def release(spark: SparkSession) -> None:
    """Has the driver forget plans of finished jobs, so that Spark's cleaner drops their shuffle files now and not when the
    driver's memory happens to be full."""
    for _ in range(2):  # what Python lets go of reaches the driver's JVM a little later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes, since a few rows may hold very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def with_rows(make: Callable[[Iterator[dict]], Iterator[tuple]], schema: pa.Schema, flush: int = 2000, flush_bytes: int = 4 << 20) -> Callable:
    """For mapInArrow: `make` gets an iterator of dicts and yields tuples; they leave in batches bounded by rows and,
    for text and binary fields, by bytes."""
    heavy = [i for i, f in enumerate(schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield dict(zip(names, row, strict=True))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        for row in make(read(batches)):
            rows.append(row)
            weight += sum(len(row[i]) for i in heavy if row[i] is not None)
            if len(rows) >= flush or weight >= flush_bytes:
                yield out(rows)
                rows, weight = [], 0
        if rows:
            yield out(rows)

    return apply


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Fixed multiplier of the rolling combination of word hashes.
STEP = 0x9E3779B97F4A7C15
#: A random value for each byte at each of the first places of a word; further places take it times a scrambled number.
PLACES = 64
PLACE_VALUES = np.random.default_rng(4711).integers(0, 1 << 63, PLACES * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Longest run of powers that is kept; longer texts make their own.
KEPT_POWERS = 1 << 20
#: Bytes that are hashed at once.
AT_ONCE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    if n > KEPT_POWERS:
        return _powers(base, n)
    if base not in _kept or len(_kept[base]) < n:
        _kept[base] = _powers(base, min(KEPT_POWERS, max(2 * n, 1 << 14)))
    return _kept[base][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, in arrays: the sum of random values, one
    for each byte and its place in the word. Long texts are taken in blocks that end at white space, so that memory stays
    a small multiple of the text, unless a single word is longer."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    if len(raw) <= AT_ONCE:
        return _hashed(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + AT_ONCE)
        while end < len(raw) and not SPACES[raw[end]]:
            step = SPACES[raw[end : end + 4096]]
            end += int(step.argmax()) if step.any() else len(step)
        parts.append(_hashed(raw[at:end]))
        at = end
    return np.concatenate(parts)


def _hashed(raw: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(SPACES[raw], prepend=True, append=True))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    begin = np.cumsum(size) - size  # in the bytes of words alone
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    letters = raw[np.repeat(start - begin, size) + np.arange(len(place))]
    values = PLACE_VALUES[(place & (PLACES - 1)) << 8 | letters]
    if int(size.max()) > PLACES:
        far = np.flatnonzero(place >= PLACES)
        values[far] = mixed(values[far] + mixed(place[far].astype(np.uint64)))
    return mixed(np.add.reduceat(values, begin) + size.astype(np.uint64))


def shingles_of(h: np.ndarray, width: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles of `width` words by position, from the hashes of the words; of fewer words, one hash of
    them all; of none, none."""
    n = len(h)
    if not n:
        return h
    k = min(width, n)
    rolled = h[: n - k + 1].copy()
    for j in range(1, k):
        rolled *= np.uint64(STEP)
        rolled += h[j : n - k + 1 + j]
    return mixed(rolled + np.uint64(k))


def as_text(column: str):
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
