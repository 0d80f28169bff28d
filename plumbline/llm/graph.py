"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common




def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b); root is the smallest node reachable.

    Each round is two aggregations with map-side minima and two joins on the node; it is written to the shared
    folder, so lineage stays short and lost executors cost one round at most. Nothing but a count and a checksum
    reaches the driver. Rounds grow with the logarithm of the longest path. Stars only need minima, so a node with
    very many links is split over map tasks, and the joins are plain ones that adaptive execution can split.
    """
    e = common.materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = common.materialize(small.select("p.u", "p.v").where(F.col("u") != F.col("v")).distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = tuple(now)
    raise RuntimeError("components did not settle")
