"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """Writes df as Parquet under spark.checkpoint.dir (a temporary folder where it is unset) and reads it back."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder of its own under the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):  # each machine would write to its own disk
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="querent-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows anew where a scan has fewer parts than there are cores, so that a small file keeps all of them busy in
    a Python step; a scan of many files stays as it is and shuffles nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
