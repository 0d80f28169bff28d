"""Named collections and changes of their declarations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection
from .errors import QueryError
from .schema import CollectionSchema


class Catalog:
    """Collections by name. Dropping is soft at first: a dropped name can be declared again, which starts empty at the
    next version, until `sweep` forgets it."""

    def __init__(self, spark: SparkSession, digits: int | None = None):
        self.spark = spark
        self.digits = digits
        self._live: dict[str, Collection] = {}
        self._dropped: dict[str, int] = {}

    def __getitem__(self, name: str) -> Collection:
        if name in self._dropped:
            raise QueryError("gone", f"collection {name!r} was dropped")
        if name not in self._live:
            raise QueryError("collection_not_found", f"no collection {name!r}")
        return self._live[name]

    def names(self) -> list[str]:
        return sorted(self._live)

    def declare(self, name: str, fields: Mapping, rows: DataFrame | None = None) -> Collection:
        """Create a collection, or add fields to one; further fields are null in the rows there are."""
        if not name or ":" in name:
            raise QueryError("invalid_collection_name", f"a collection cannot be named {name!r}")
        if name in self._live:
            old = self._live[name]
            schema = old.schema.merged(fields, self._occupied(old, fields))
            rows = old.rows if rows is None else rows
            for n, s in schema.fields.items():
                if n not in rows.columns:
                    rows = rows.withColumn(n, F.lit(None).cast(s.spark_type))
        else:
            schema = CollectionSchema.of(fields)
            if name in self._dropped:
                schema = CollectionSchema(schema.fields, self._dropped.pop(name) + 1)
            if rows is None:
                rows = self.spark.createDataFrame([], schema.spark_schema())
        return self.put(name, rows, schema)

    def _occupied(self, old: Collection, fields: Mapping) -> set[str]:
        """Known fields that hold documents, looked at only where a declaration differs."""
        changed = [n for n in fields if n in old.schema.fields and CollectionSchema.of({n: fields[n]}).fields[n] != old.schema.fields[n]]
        return {n for n in changed if not old.rows.where(F.col(n).isNotNull()).isEmpty()}

    def put(self, name: str, rows: DataFrame, schema: CollectionSchema | None = None) -> Collection:
        """Replace a collection's rows by another version of them."""
        schema = schema or self[name].schema
        self._live[name] = Collection(rows, schema, self, self.digits)
        return self._live[name]

    def drop_field(self, name: str, field: str) -> Collection:
        """Without the field; documents that held nothing else are gone."""
        old = self[name]
        schema = old.schema.without(field)
        rows = old.rows.drop(field)
        live = F.lit(False)
        for n in schema.fields:
            live = live | F.col(n).isNotNull()
        return self.put(name, rows.where(live), schema)

    def drop(self, name: str, force: bool = False) -> None:
        version = self[name].schema.version
        del self._live[name]
        if not force:
            self._dropped[name] = version

    def sweep(self) -> list[str]:
        """Forget dropped collections."""
        gone = sorted(self._dropped)
        self._dropped.clear()
        return gone
