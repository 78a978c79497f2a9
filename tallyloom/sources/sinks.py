"""Sinks: tables in generations that are swapped as a whole, JSON lines with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT.json"
#: Rows of an exported file at most; a file is read whole when its digest is taken.
ROWS_PER_FILE = 500_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _pointer(spark: SparkSession, path: str) -> dict:
    """What the table consists of: a number and, by partition, the folder that holds it. Empty for a table that isn't there yet."""
    fs, p = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return {"generation": 0, "folders": {}, "schema": None}
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/{POINTER}").collect()))


def _swap(spark: SparkSession, path: str, pointer: dict) -> None:
    """The pointer is written beside and renamed over the old one, the only step that readers see."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs, beside = _fs(spark, f"{path}/_{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(pointer), "utf-8"))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(beside, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as the pointer has it; a job that reads it keeps its version while later ones are published."""
    pointer = _pointer(spark, path)
    if pointer["schema"] is None:
        raise FileNotFoundError(f"no table at {path}")
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(pointer["schema"])
    folders = [f"{path}/{f}" for f in pointer["folders"].values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def publish(df: DataFrame, path: str, by: list[str], scope: Column | None = None, before_swap=None) -> int:
    """Makes df the content of the table's partitions and gives the generation's number. Without `scope` the whole table is
    replaced; with it, a condition on the columns `by`, the partitions that it holds for: those among them that df has no rows for
    are gone, all others stay where they lie. Rows of df must be in scope. Files are written first, under a name of their own; a
    run that fails leaves the old version to readers. before_swap is called in between. Partitions are named in the pointer,
    so they should be thousands, not millions."""
    spark = df.sparkSession
    old = _pointer(spark, path)
    number, stage = old["generation"] + 1, f"gen-{uuid.uuid4().hex}"
    name = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in by]), 256)
    keyed = df.withColumn("_partition", name)
    if scope is not None and df.filter(~F.coalesce(scope, F.lit(False))).limit(1).count():
        raise ValueError("a row lies outside the scope")
    keyed.write.option("compression", "zstd").partitionBy("_partition").parquet(f"{path}/{stage}")
    fs, place = _fs(spark, f"{path}/{stage}")
    written = {s.getPath().getName().removeprefix("_partition="): f"{stage}/{s.getPath().getName()}" for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("_partition=")}
    kept = {}
    if scope is not None and old["folders"]:
        had = current(spark, path).filter(scope).select(name.alias("k")).distinct()
        gone = {r["k"] for r in had.collect()}
        kept = {k: f for k, f in old["folders"].items() if k not in gone}
    if before_swap:
        before_swap()
    _swap(spark, path, {"generation": number, "folders": kept | written, "schema": df.schema.jsonValue()})
    return number


def plain(df: DataFrame) -> DataFrame:
    """Decimals and dates as text, as JSON exports want them."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("string").alias(c) if k.startswith("decimal") else F.date_format(c, "yyyy-MM-dd").alias(c) if k == "date" else F.col(c) for c, k in kinds.items()])


def file_digests(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """table, file, n_bytes, n_rows, sha256 of the exported files as they lie there; each file is read as a whole by a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load([f"{path}/{n}" for n in names])
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return files.select(part(-2).alias("table"), part(-1).alias("file"), F.col("length").alias("n_bytes"), F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n")).cast("long").alias("n_rows"), F.sha2("content", 256).alias("sha256"))


def export_json_lines(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None, revision: str = "") -> DataFrame:
    """Writes each table as JSON lines under path, in files of ROWS_PER_FILE rows at most, and returns the manifest, which lies
    beside them: table, file, n_bytes, n_rows, sha256, revision. With `keys` a table's rows must have a key each and no key twice."""
    spark = next(iter(tables.values())).sparkSession
    for name, key in (keys or {}).items():
        bad = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | ~F.forall(F.array(*[F.col(k).isNotNull() for k in key]), lambda x: x))
        if bad.limit(1).count():
            raise ValueError(f"{name}: keys {key} are missing or not unique")
    for name, df in tables.items():
        plain(df).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).json(f"{path}/{name}")
    manifest = file_digests(spark, path, list(tables)).withColumn("revision", F.lit(revision))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def export_faults(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """table, file, fault (missing, changed or unknown) of the files that differ from the manifest."""
    there = file_digests(spark, path, names).select("table", "file", F.col("sha256").alias("now"))
    said = spark.read.schema("table string, file string, sha256 string").json(f"{path}/manifest")
    both = said.join(there, ["table", "file"], "full")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("table", "file", fault.alias("fault")).filter("fault is not null")


def gold_lines(labels: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """A row per key with a map of its fields."""
    return labels.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))
