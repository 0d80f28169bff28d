"""Shared pieces of the training-data operators: written intermediate tables, words, table loading."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that separate words; everything else is part of a word.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a folder of our own, which only
    a local session has for all its tasks: on a cluster that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths made meanwhile, for a caller that removes them once what was read from them is written."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [r for r in _recorders if r is not paths]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}-{tag}"
    fs, p = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    for r in _recorders:
        r.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def write_out(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return write_out(df, tag)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """Array of the words of a text column, [^\\x20\\x09-\\x0D]+; null text: empty array. JVM only.

    The blanks are mapped to a space first, so that the split is on one plain character, which Java does without
    a regular expression engine."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * 5)
    return F.filter(F.split(flat, " "), lambda w: w != "")


def n_partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A number that tells rows apart even where doc_id is null or repeated; stable once written out."""
    return df.withColumn(name, F.monotonically_increasing_id())


def struct_type(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
