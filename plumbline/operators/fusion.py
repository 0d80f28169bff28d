"""Reciprocal rank fusion: each leg ranks its hits, and a hit's score is the sum of 1 / (k + rank) over its legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def rank_few(leg: DataFrame) -> DataFrame:
    """Ranks of a leg with a proven bound (a kNN leg): one window."""
    return leg.select("external_id", F.row_number().over(Window.orderBy(F.desc("score"), "external_id")).cast("long").alias("rank"))


def rank_many(leg: DataFrame) -> DataFrame:
    """Ranks of a leg of any size: range-sorted once and written, then every partition's rows are numbered from the
    rows before it. No task sees more than a partition; the offsets are one row a partition."""
    spark = leg.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc("external_id")]
    spread = leg.select("external_id", "score").repartitionByRange(n, *order).sortWithinPartitions(*order)
    saved = written(spread.select("external_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "ranks")
    parts = saved.groupBy("p").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("p", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    # One row a partition of the sort: bounded by spark.sql.shuffle.partitions.
    return saved.join(F.broadcast(parts), "p").select("external_id", (F.col("m") - F.col("first") + F.col("before") + 1).alias("rank"))


def fuse(ranked: list[DataFrame], k: int) -> DataFrame:
    """(external_id, score) of all hits of any leg."""
    base = max(k, 1)
    legs = [r.select("external_id", (1.0 / (base + F.col("rank"))).alias("part"), F.lit(i).alias("leg")) for i, r in enumerate(ranked)]
    both = reduce(DataFrame.unionByName, legs)
    # A hit has one part a leg; adding them in the order of the legs makes the sum the same on every run.
    parts = both.groupBy("external_id").agg(*[F.max(F.when(F.col("leg") == i, F.col("part"))).alias(f"p{i}") for i in range(len(legs))])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"p{i}"), F.lit(0.0)) for i in range(len(legs))])
    return parts.select("external_id", total.alias("score"))
