"""Rebuilding a collection beside the live one: ordered chunks into a shadow folder, then one switch.

    pending -> streaming -> sealing -> done, and from any of the first three to cancelled or failed

A chunk carries its number; only the next one is taken, so a chunk that is sent twice is noticed rather than doubled.
Readers keep the live rows until `finish` hands the shadow's rows to the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalog import Catalog
from ..collection import Collection
from ..errors import QueryError
from ..schema import CollectionSchema

_NEXT = {"pending": {"streaming"}, "streaming": {"sealing"}, "sealing": {"done"}}
ENDED = frozenset({"done", "cancelled", "failed"})


class Rebuild:
    def __init__(self, catalog: Catalog, name: str, schema: CollectionSchema, path: str):
        self.catalog, self.name, self.schema, self.path = catalog, name, schema, path.rstrip("/")
        self.phase, self.chunks, self.documents, self.reason = "pending", 0, 0, None

    def _move(self, to: str) -> None:
        allowed = _NEXT.get(self.phase, set()) | (set() if self.phase in ENDED else {"cancelled", "failed"})
        if to not in allowed:
            raise QueryError("bad_request", f"a rebuild that is {self.phase} cannot become {to}")
        self.phase = to

    def start(self) -> None:
        self._move("streaming")

    def chunk(self, number: int, rows: DataFrame) -> None:
        """Write the next chunk to the shadow. A failed write leaves the progress as it was."""
        if self.phase != "streaming":
            raise QueryError("bad_request", f"a rebuild that is {self.phase} takes no chunks")
        if number != self.chunks:
            raise QueryError("bad_request", f"chunk {self.chunks} comes next, not {number}")
        own = rows.select("external_id", *[rows[f"`{n}`"] for n in self.schema.fields])
        own.write.mode("overwrite").parquet(f"{self.path}/chunk={number}")
        self.documents += self.catalog.spark.read.parquet(f"{self.path}/chunk={number}").count()
        self.chunks += 1

    def seal(self) -> None:
        self._move("sealing")

    def finish(self) -> Collection:
        """Switch the catalog over; of rows with the same id the one of the later chunk stays."""
        from pyspark.sql import functions as F

        self._move("done")
        spark = self.catalog.spark
        if not self.chunks:
            return self.catalog.put(self.name, spark.createDataFrame([], self.schema.spark_schema()), self.schema)
        rows = spark.read.parquet(self.path)
        fields = F.struct(*self.schema.fields)
        last = rows.groupBy("external_id").agg(F.max_by(fields, "chunk").alias("x")).select("external_id", "x.*")
        return self.catalog.put(self.name, last, self.schema)

    def cancel(self) -> None:
        self._move("cancelled")

    def fail(self, reason: str) -> None:
        self._move("failed")
        self.reason = reason
