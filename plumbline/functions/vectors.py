"""Distances between vectors as expressions over arrays, in double precision, and scalar quantisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector]) if vector else F.array().cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalized(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine; 0 where either vector is zero."""
    both = norm(a) * (norm(b) if b_norm is None else b_norm)
    return F.when(both > 0, inner(a, b) / both).otherwise(F.lit(0.0))


def nearness(a: Column, b: Column, metric: str, b_norm: Column | None = None) -> Column:
    """Larger is nearer: minus the distance, which is 1 - cosine, -inner product or the Euclidean one."""
    if metric == "cosine":
        return cosine(a, b, b_norm) - 1.0
    if metric == "dot":
        return inner(a, b)
    if metric == "l2":
        return -euclidean(a, b)
    raise QueryError("bad_request", f"unknown metric {metric!r}")


def quantize(df: DataFrame, column: str, out: str, corpus: DataFrame | None = None) -> DataFrame:
    """Adds `out`: the vectors as they read back from one byte a component, over the range of all components of
    `corpus` (df itself if not given).

    The range is one row, taken as a scalar subquery, so the plan stays lazy."""
    ends = (df if corpus is None else corpus).select(F.array_min(column).alias("lo"), F.array_max(column).alias("hi")).agg(F.min("lo").cast("double").alias("lo"), F.max("hi").cast("double").alias("hi"))
    with_ends = df.withColumn("__sq", ends.select(F.struct("lo", "hi")).scalar())
    lo, span = F.col("__sq.lo"), F.col("__sq.hi") - F.col("__sq.lo")
    code = lambda x: F.when(span > 0, F.round((x.cast("double") - lo) / span * 255.0)).otherwise(F.lit(0.0))
    return with_ends.withColumn(out, F.transform(F.col(column), lambda x: code(x) * span / 255.0 + lo)).drop("__sq")
