"""Streams of changes: folded batch by batch into versions on storage, and event-time helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import CollectionSchema
from . import fold


class Versions:
    """Numbered states under a path. A version is complete once its folder carries Spark's success mark, and is never
    written again, so readers and a restarted stream see whole versions only."""

    def __init__(self, spark: SparkSession, path: str, schema: CollectionSchema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def numbers(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                found.append(int(name[2:]))
        return sorted(found)

    def state(self, below: int | None = None) -> DataFrame:
        """The latest state, or the latest before a version."""
        have = [v for v in self.numbers() if below is None or v < below]
        if not have:
            return fold.empty_state(self.spark, self.schema)
        return self.spark.read.schema(fold.state_schema(self.schema)).parquet(f"{self.path}/v={have[-1]}")

    def write(self, version: int, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def documents(self) -> DataFrame:
        return fold.live(self.state(), self.schema)


def apply(versions: Versions, batch: DataFrame, number: int) -> None:
    """Fold one batch. The same number again gives the same version, so a replayed batch changes nothing."""
    versions.write(number, fold.fold(versions.state(below=number), batch, versions.schema))


def start(changes: DataFrame, versions: Versions, checkpoint: str, once: bool = False, first: int = 0) -> StreamingQuery:
    """Fold a stream of change rows as it comes (or all there is, with `once`).

    A request sent again is known by its id and the content of its rows, for as long as a batch fold would remember
    it; the watermark bounds what has to be kept. Equal rows of one request count once. Batch n makes version
    `first` + n."""
    marked = changes.withWatermark("at", f"{fold.REMEMBER_SECONDS} seconds")
    content = F.xxhash64("op", "external_id", "version", "fields", "items")
    key = F.when(F.col("request_id").isNotNull(), F.concat_ws(":", F.lit("r"), "request_id", content)).otherwise(F.concat_ws(":", F.lit("s"), "seq"))
    kept = marked.withColumn("__key", key).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    writer = kept.writeStream.foreachBatch(lambda b, n: apply(versions, b, first + n)).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
