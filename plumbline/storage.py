"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a folder of our own, which only a local session has for all
    its tasks: on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}-{tag}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back: lineage ends here, and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
