"""Nearest neighbours by exact scan: top k of one query, within a filter, or of many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import vectors

#: Queries of one batch that are sent to all tasks; beyond it the batch is split by the caller.
MAX_QUERIES = 1000


def check(vector: Sequence, dim: int | None) -> list[float]:
    out = []
    for x in vector:
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            raise QueryError("type_mismatch", "a vector holds numbers")
        out.append(float(x))
    if dim is not None and len(out) != dim:
        raise QueryError("type_mismatch", f"the vector has {len(out)} components, the field {dim}")
    return out


def score(column: Column, vector: Sequence[float], metric: str) -> Column:
    length = sum(x * x for x in vector) ** 0.5
    return vectors.nearness(column, vectors.literal(vector), metric, F.lit(length))


def top_k(rows: DataFrame, field: str, vector: Sequence[float], metric: str, k: int, digits: int | None = None) -> DataFrame:
    """(external_id, score) of the k nearest rows that have a vector; ties go to the smaller id.

    The plan is one scan with a bounded heap a task (TakeOrderedAndProject); no shuffle of the table."""
    s = score(F.col(field), vector, metric)
    s = s if digits is None else F.round(s, digits)
    return rows.where(F.col(field).isNotNull()).select("external_id", s.alias("score")).orderBy(F.desc("score"), "external_id").limit(k)


def batch_top_k(rows: DataFrame, field: str, queries: dict[str, Sequence[float]], metric: str, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, external_id, score, rank) for many queries in one scan.

    The queries are a literal of at most MAX_QUERIES vectors. Each row keeps no more than its scores, and tasks keep
    the best k of each query before anything moves: partial aggregation by a bounded sorted list."""
    if len(queries) > MAX_QUERIES:
        raise QueryError("bulk_limit", f"at most {MAX_QUERIES} queries a batch")
    each = [F.struct(F.lit(q).alias("query_id"), score(F.col(field), v, metric).alias("score")) for q, v in queries.items()]
    scored = rows.where(F.col(field).isNotNull()).select("external_id", F.explode(F.array(*each)).alias("x"))
    value = F.col("x.score") if digits is None else F.round("x.score", digits)
    scored = scored.select(F.col("x.query_id").alias("query_id"), "external_id", value.alias("score"))
    # Row numbers with a limit: Spark prunes each task's groups to k rows before the shuffle (WindowGroupLimit).
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "external_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
