"""Tables that a job writes once and reads several times, in the folder that driver and executors share. A written table cuts
the lineage: what is lost with an executor is read again, not made again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of this machine only for a local session that names none."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not place and found.isDefined():
        place = found.get()
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
        place = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return place.rstrip("/")


def staged(df: DataFrame, kind: str, *partitions: str) -> DataFrame:
    """df as a table in the shared folder, by the columns `partitions` if any are named. Nobody else writes to its path; the
    folder `staged` may be deleted after the job."""
    path = f"{shared_folder(df.sparkSession)}/staged/{kind}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
