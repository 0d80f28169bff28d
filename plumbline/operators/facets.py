"""Exact facets and metrics over the whole match set, before paging and collapse."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..schema import CollectionSchema
from .groups import values_of

# Sizes of terms facets.
DEFAULT_SIZE, MAX_SIZE = 10, 100
METRICS = ("count", "value_count", "min", "max", "sum", "avg")


@dataclass(frozen=True)
class Facet:
    """buckets (value or key, count) and a one-row summary."""

    buckets: DataFrame
    summary: DataFrame


def terms(hits: DataFrame, schema: CollectionSchema, field: str, size: int = DEFAULT_SIZE, order: str = "count_desc", prefix: str | None = None, min_count: int = 1) -> Facet:
    """Counts of documents by value; a document counts once for each of its values."""
    schema.need(field, "facet")
    if not 1 <= size <= MAX_SIZE:
        raise QueryError("bad_request", f"a facet has 1 to {MAX_SIZE} buckets")
    by = {"count_desc": [F.desc("count"), F.asc("value")], "value_asc": [F.asc("value")], "value_desc": [F.desc("value")]}
    if order not in by:
        raise QueryError("bad_request", f"unknown facet order {order!r}")
    each = values_of(hits, schema, field)
    if prefix is not None:
        each = each.where(F.col("value").cast("string").startswith(prefix))
    counted = each.groupBy("value").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    distinct = counted.agg(F.count(F.lit(1)).alias("n")).select("n")
    missing = hits.agg(F.count(F.when(_missing(schema, field), 1)))
    summary = distinct.select(F.col("n").alias("distinct_value_count"), (F.col("n") > size).alias("truncated"), missing.scalar().alias("missing_count"))
    return Facet(counted.orderBy(*by[order]).limit(size), summary)


def _missing(schema: CollectionSchema, field: str) -> Column:
    c = F.col(field)
    return (c.isNull() | (F.size(c) == 0)) if schema[field].stored == "set" else c.isNull()


def ranges(hits: DataFrame, schema: CollectionSchema, field: str, buckets: list[Mapping]) -> Facet:
    """Counts of documents in half-open intervals [from, to), all in one pass. Buckets are sorted and do not overlap;
    only the first may lack `from` and only the last `to`."""
    schema.need(field, "range_facet")
    keys, last = set(), None
    for i, b in enumerate(buckets):
        if set(b) - {"key", "from", "to"} or "key" not in b or b["key"] in keys:
            raise QueryError("bad_request", "a bucket has a key of its own, and may have from and to")
        low, high = b.get("from"), b.get("to")
        open_inside = (low is None and i > 0) or (high is None and i < len(buckets) - 1)
        if open_inside or (low is not None and high is not None and not low < high) or (last is not None and low < last):
            raise QueryError("bad_request", "buckets must be sorted and must not overlap")
        keys.add(b["key"])
        last = high
    c = F.col(field)

    def inside(b: Mapping) -> Column:
        cond = c.isNotNull()
        cond = cond & (c >= F.lit(b["from"])) if b.get("from") is not None else cond
        return cond & (c < F.lit(b["to"])) if b.get("to") is not None else cond

    every = [inside(b) for b in buckets]
    outside = c.isNotNull()
    for cond in every:
        outside = outside & ~F.coalesce(cond, F.lit(False))
    sums = hits.agg(
        *[F.count(F.when(cond, 1)).alias(f"b{i}") for i, cond in enumerate(every)],
        F.count(F.when(outside, 1)).alias("unbucketed"),
        F.count(F.when(c.isNull(), 1)).alias("missing"),
    )
    rows = F.explode(F.array(*[F.struct(F.lit(b["key"]).alias("key"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)]))
    summary = sums.select(F.col("unbucketed").alias("unbucketed_document_count"), F.col("missing").alias("missing_count"))
    return Facet(sums.select(rows.alias("x")).select("x.key", "x.count"), summary)


def metric_columns(schema: CollectionSchema, field: str) -> dict[str, Column]:
    """The six metrics of a single-valued field as aggregate columns, so that many fit into one pass.

    Sums of whole numbers and decimals are exact; a decimal average is rounded half-even to 18 places."""
    spec = schema.need(field, "metric")
    c = F.col(field)
    if spec.stored == "number":
        total, mean = F.sum(c), F.try_divide(F.sum(c), F.count(c))
    else:
        total = F.sum(c.cast("decimal(38,0)") if spec.stored == "int64" else c.cast(f"decimal(38,{spec.scale})"))
        mean = F.bround(F.try_divide(total, F.count(c)), 18)
    return {"count": F.count(c), "value_count": F.count(c), "min": F.min(c), "max": F.max(c), "sum": total, "avg": mean}


def metrics(hits: DataFrame, schema: CollectionSchema, wanted: Mapping[str, Mapping]) -> DataFrame:
    """One row with a column for every wanted metric: {name: {"kind": ..., "field": ...}}."""
    cols = []
    for name, w in wanted.items():
        if w.get("kind") not in METRICS:
            raise QueryError("bad_request", f"unknown metric {w.get('kind')!r}")
        cols.append(metric_columns(schema, w["field"])[w["kind"]].alias(name))
    return hits.agg(*cols)
