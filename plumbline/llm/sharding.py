"""Sharding by fixed virtual slots (JVM only).

Every record hashes to one of `n_slots` virtual slots. A stored, versioned map says which shard owns each slot.
Version n of the map (n shards) is derived from version n-1 by handing the new shard an equal share of its
predecessors' slots, so a record's shard follows from its key and the shard count alone (law `key`), and growth moves
rows only into the new shard. Bytes and rows are aggregated per slot (n_slots rows whatever the corpus size); a
rebalance edits the latest version by those bytes and stores it as the next one (`SlotMaps.rebalance`). The query
stores the maps of n and n+1 shards and an edited one, reads them back, and gives each record's owner under all three.

Defined cases: a null text counts no bytes and has crc32 0 (size 1); a null key hashes as the empty string; rows
that repeat a key share its shard and get different positions; empty tables give empty results; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N_SLOTS = 4096


def slot_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Owner of every slot for `n_shards` shards; map n+1 differs from map n only in slots that the new shard owns."""
    if not 1 <= n_shards <= n_slots:
        raise ValueError("the number of shards must be between 1 and the number of slots")
    owner = [0] * n_slots
    for new in range(1, n_shards):
        held: list[list[int]] = [[] for _ in range(new)]
        for slot, shard in enumerate(owner):
            held[shard].append(slot)
        for _ in range(n_slots // (new + 1)):
            donor = max(range(new), key=lambda s: (len(held[s]), s))
            owner[held[donor].pop()] = new
    return owner


def rebalance(owner: list[int], slot_bytes: list[int], n_shards: int) -> list[int]:
    """An edited copy of a slot map: slots move from the fullest to the emptiest shard while that narrows the spread."""
    owner, load = list(owner), [0] * n_shards
    for slot, shard in enumerate(owner):
        load[shard] += slot_bytes[slot]
    for _ in range(len(owner)):
        top, low = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        half = (load[top] - load[low]) / 2
        movable = [s for s, o in enumerate(owner) if o == top and 0 < slot_bytes[s] <= half]
        if not movable:
            break
        slot = max(movable, key=lambda s: slot_bytes[s])
        owner[slot] = low
        load[top] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
    return owner


class SlotMaps:
    """Versions of a slot map on storage: (version, n_shards, vslot, owner), each version written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, owner: list[int], n_shards: int) -> None:
        rows = [(n_shards, s, o) for s, o in enumerate(owner)]
        made = self.spark.createDataFrame(rows, "n_shards int, vslot int, owner int").coalesce(1)
        made.write.mode("errorifexists").parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def rebalance(self, version: int, slot_bytes: DataFrame, to: int) -> None:
        """Store version `to`: `version` edited by (vslot, slot_bytes). Both are n_slots rows, whatever the corpus."""
        rows = self.read(version).join(F.broadcast(slot_bytes), "vslot", "left").orderBy("vslot").collect()
        n = rows[0]["n_shards"]
        self.write(to, rebalance([r["owner"] for r in rows], [r["slot_bytes"] or 0 for r in rows], n), n)


def virtual_slot(key, n_slots: int = N_SLOTS):
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n_slots)).cast("int")


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc key, size, text_crc32, law, shard, slot (position in the shard, gapless from 0), grown_shard, vslot, and
    rebalanced_shard, the owner under the map edited by bytes.

    Positions are counted in two levels: rows of a slot inside a block of 65,536 rows as they were written, then blocks
    in order, so a key that a third of all rows hold meets in no task. The joined maps have n_slots rows, a constant,
    which is why they are broadcast.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lean = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        (F.octet_length(own) + 1).cast("long").alias("size"),
        F.crc32(F.encode(own, "UTF-8")).alias("text_crc32"),
        virtual_slot(F.col(f"`{key}`"), n_slots).alias("vslot"),
    )
    lean = common.materialize(lean.withColumn("row", F.monotonically_increasing_id()), "sizes")
    lean = lean.withColumn("block", F.shiftright("row", 16))
    cells = common.materialize(lean.groupBy("vslot", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "cells")
    per_slot = cells.groupBy("vslot").agg(F.sum("n").alias("slot_rows"), F.sum("bytes").alias("slot_bytes"))
    maps = SlotMaps(spark, common.new_path(spark, "maps"))
    for n in (n_shards, n_shards + 1):
        maps.write(n, slot_map(n, n_slots), n)
    edited = n_shards + 2
    maps.rebalance(n_shards, per_slot.select("vslot", "slot_bytes"), edited)
    owners = maps.read(n_shards).select("vslot", F.col("owner").alias("shard"))
    for version, name in ((n_shards + 1, "grown_shard"), (edited, "rebalanced_shard")):
        owners = owners.join(F.broadcast(maps.read(version).select("vslot", F.col("owner").alias(name))), "vslot")
    upto = lambda *by: Window.partitionBy(by[0]).orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)
    at = per_slot.join(F.broadcast(owners), "vslot").withColumn("first", F.coalesce(F.sum("slot_rows").over(upto("shard", "vslot")), F.lit(0)))
    blocks = cells.select("vslot", "block", F.coalesce(F.sum("n").over(upto("vslot", "block")), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block", "vslot").orderBy("row")
    return (
        lean.withColumn("place", F.row_number().over(inside) - 1)
        .join(blocks, ["vslot", "block"])
        .join(F.broadcast(at), "vslot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("first") + F.col("before") + F.col("place")).cast("long").alias("slot"),
            "grown_shard",
            "vslot",
            "rebalanced_shard",
        )
    )


def slot_report(sharded: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Bytes and rows of every occupied slot with its owner: what a rebalance is decided on (n_slots rows at most)."""
    return sharded.groupBy("vslot", "shard").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, n_slots: int = N_SLOTS, key: str = "doc_id", version: int = 1) -> None:
    """Write whole records partitioned by shard, and the slot map they follow as a version beside them."""
    spark = docs.sparkSession
    maps = SlotMaps(spark, f"{path}/_map")
    maps.write(version, slot_map(n_shards, n_slots), n_shards)
    name = "__h_vslot"
    now = maps.read(version).select(F.col("vslot").alias(name), F.col("owner").alias("shard"))
    dealt = docs.withColumn(name, virtual_slot(F.col(f"`{key}`"), n_slots)).join(F.broadcast(now), name)
    dealt.repartition("shard", name).drop(name).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/data/version={version}")
