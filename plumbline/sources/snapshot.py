"""Versions of a collection on storage: the rows as Parquet beside the declaration as JSON, and routed subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..collection import Collection
from ..errors import QueryError
from ..functions.values import BUCKETS, route
from ..schema import CollectionSchema


def save(collection: Collection, path: str) -> None:
    """Write a full snapshot; an existing one at the path is replaced."""
    spark = collection.rows.sparkSession
    collection.rows.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(collection.schema.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def load(catalog: Catalog, name: str, path: str) -> Collection:
    """A collection of the catalog from a snapshot. Scans prune columns and push predicates down as on any Parquet."""
    text = catalog.spark.read.text(f"{path}/schema").first()
    if text is None:
        raise QueryError("bad_request", f"no snapshot at {path}")
    schema = CollectionSchema.from_json(text["value"])
    rows = catalog.spark.read.parquet(f"{path}/rows")
    return catalog.put(name, rows, schema)


def of_buckets(rows: DataFrame, collection: str, buckets: list[int], n: int = BUCKETS, key: str = "external_id") -> DataFrame:
    """The rows that route to the given virtual buckets."""
    return rows.where(route(collection, F.col(key), n).isin([int(b) for b in buckets]))


def add_subset(rows: DataFrame, subset: DataFrame) -> DataFrame:
    """With a subset moved in; its rows win over those of the same id."""
    return rows.join(subset.select("external_id"), "external_id", "left_anti").unionByName(subset)


def keep_buckets(rows: DataFrame, collection: str, buckets: list[int], n: int = BUCKETS) -> DataFrame:
    """Without the rows of other buckets: what a move leaves behind."""
    return of_buckets(rows, collection, buckets, n)


def split_shards(owner: list[int], new: int) -> list[int]:
    """The owners of virtual buckets when shards 0..new-1 give an equal part of theirs to shard `new`."""
    counts = [owner.count(s) for s in range(new)]
    give = [c // (new + 1) for c in counts]
    out = list(owner)
    for b in range(len(out) - 1, -1, -1):
        if out[b] < new and give[out[b]]:
            give[out[b]] -= 1
            out[b] = new
    return out


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")
