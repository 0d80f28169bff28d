"""Changes folded into documents by aggregation alone.

A change row is (seq, op, external_id, version, fields, items): `seq` is the order, `op` one of

    merge         sets the fields named in `items`; per field, a version not above the stored one is dropped
    replace       makes the document exactly `fields`; a version not above the document's stored one drops it whole
    delete        removes the document, or the fields named in `items`; versions stay
    unindex       removes the document and its versions
    truncate      empties the collection

Writes without a version always count and leave versions alone. Because an accepted version is always the largest so
far, the last accepted versioned write is the one with the largest version (the first of equals): no row-by-row replay
is needed. Every cell's value is the latest of a few candidates, each a maximum, so one aggregation with map-side
combine folds any number of changes, and a document with very many changes is no hot spot.

The state is the collection's rows with two more columns: `doc_version` and `cell_versions` (a struct by field).
Documents that are gone but whose versions still count stay in the state with all fields null; `live` drops them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..schema import CollectionSchema

OPS = ("merge", "replace", "delete", "unindex", "truncate")
# Sizes of a write, and how long a request id is remembered.
MAX_REPLACE, MAX_UNINDEX, MAX_MERGE = 32, 1000, 10_000
REMEMBER_SECONDS = 300


def change_schema(schema: CollectionSchema) -> T.StructType:
    return T.StructType(
        [
            T.StructField("seq", T.LongType(), False),
            T.StructField("op", T.StringType(), False),
            T.StructField("external_id", T.StringType()),
            T.StructField("version", T.LongType()),
            T.StructField("fields", _fields_type(schema)),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("request_id", T.StringType()),
            T.StructField("at", T.TimestampType()),
        ]
    )


def _fields_type(schema: CollectionSchema) -> T.StructType:
    return T.StructType([T.StructField(n, s.spark_type) for n, s in schema.fields.items()])


def state_schema(schema: CollectionSchema) -> T.StructType:
    versions = T.StructType([T.StructField(n, T.LongType()) for n in schema.fields])
    return T.StructType([*schema.spark_schema().fields, T.StructField("doc_version", T.LongType()), T.StructField("cell_versions", versions)])


def empty_state(spark: SparkSession, schema: CollectionSchema) -> DataFrame:
    return spark.createDataFrame([], state_schema(schema))


def as_state(rows: DataFrame, schema: CollectionSchema) -> DataFrame:
    """Plain rows as a state without versions."""
    versions = state_schema(schema)["cell_versions"].dataType
    return rows.select("external_id", *schema.fields, F.lit(None).cast("long").alias("doc_version"), F.lit(None).cast(versions).alias("cell_versions"))


def live(state: DataFrame, schema: CollectionSchema) -> DataFrame:
    """The documents that have a value."""
    some = F.lit(False)
    for n in schema.fields:
        some = some | F.col(f"`{n}`").isNotNull()
    return state.where(some).select("external_id", *[F.col(f"`{n}`") for n in schema.fields])


def merge_rows(spark: SparkSession, schema: CollectionSchema, changes: Iterable[Mapping]) -> DataFrame:
    """Change rows from Python values: {seq, op, external_id, version, fields: {...}, request_id, at}. Field names and
    ops are checked here; a value of another type than its field's is refused by Spark."""
    out = []
    for c in changes:
        fields = dict(c.get("fields") or {})
        for n in fields:
            schema[n]
        if c["op"] not in OPS:
            raise QueryError("bad_request", f"unknown op {c['op']!r}")
        items = list(c.get("items") or [])
        for n in items:
            schema[n]
        if c["op"] == "merge":
            items = [n for n in fields if not _empty(fields[n], schema[n].stored)]
        row = tuple(None if _empty(fields.get(n), s.stored) else _clean(fields.get(n), s.stored) for n, s in schema.fields.items())
        out.append((c["seq"], c["op"], c.get("external_id"), c.get("version"), row, items, c.get("request_id"), c.get("at")))
    return spark.createDataFrame(out, change_schema(schema))


def _empty(value, kind: str) -> bool:
    return value is None or (kind != "vector" and isinstance(value, (list, tuple)) and not value)


def _clean(value, kind: str):
    if kind == "set" and value is not None:
        return list(dict.fromkeys(value))
    return float(value) if kind == "number" and value is not None else value


def without_repeats(changes: DataFrame, seconds: int = REMEMBER_SECONDS) -> DataFrame:
    """Without changes whose request id was accepted within the last `seconds`; a repeat does not prolong that.

    All changes of a request share its first row's time. A request id has as many entries as the request was sent
    times, so the array folded here is as short as a caller's patience."""
    sends = changes.where(F.col("request_id").isNotNull()).groupBy("request_id", "at").agg(F.min("seq").alias("seq"))
    times = sends.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("at", "seq"))).alias("sent"))
    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.array().cast("array<timestamp>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fresh = a["last"].isNull() | (x["at"].cast("double") - a["last"].cast("double") > seconds)
        return F.struct(F.when(fresh, x["at"]).otherwise(a["last"]).alias("last"), F.when(fresh, F.array_append(a["kept"], x["at"])).otherwise(a["kept"]).alias("kept"))

    kept = times.select("request_id", F.explode(F.aggregate("sent", start, step, lambda a: a["kept"])).alias("at"))
    plain = changes.where(F.col("request_id").isNull())
    return plain.unionByName(changes.join(kept, ["request_id", "at"], "left_semi").select(*changes.columns))


def fold(state: DataFrame, changes: DataFrame, schema: CollectionSchema) -> DataFrame:
    """The next state: one aggregation of the changes by document, and one join with the state."""
    names = list(schema.fields)
    emptied = changes.where(F.col("op") == "truncate").agg(F.max("seq"))
    after = F.coalesce(emptied.scalar(), F.lit(-(2**62)))
    recent = changes.where((F.col("op") != "truncate") & F.col("external_id").isNotNull()).withColumn("__t", after).where(F.col("seq") > F.col("__t")).drop("__t")
    cleared = recent.where(F.col("op") == "unindex").groupBy("external_id").agg(F.max("seq").alias("__u"))
    recent = recent.where(F.col("op") != "unindex").join(cleared, "external_id", "left")
    recent = recent.where(F.col("__u").isNull() | (F.col("seq") > F.col("__u"))).drop("__u")
    old = state.withColumn("__t", after).where(F.col("__t") == -(2**62)).drop("__t").join(cleared, "external_id", "left_anti")
    op, seq, version = F.col("op"), F.col("seq"), F.col("version")
    whole = (op == "replace") | ((op == "delete") & (F.size(F.coalesce("items", F.array().cast("array<string>"))) == 0))
    content = F.struct(*[F.when(op == "replace", F.col(f"fields.`{n}`")).alias(n) for n in names])
    put = F.struct(seq.alias("seq"), version.alias("version"), content.alias("doc"))
    aggs = [
        F.max_by(put, F.when((op == "replace") & version.isNotNull(), F.struct(version, -seq))).alias("__rv"),
        F.max_by(put, F.when(whole & ((op == "delete") | version.isNull()), seq)).alias("__ru"),
    ]
    for i, n in enumerate(names):
        touches = F.array_contains("items", n)
        merge = (op == "merge") & touches
        cell = F.struct(seq.alias("seq"), version.alias("version"), F.when(op == "merge", F.col(f"fields.`{n}`")).alias("v"))
        aggs += [
            F.max_by(cell, F.when(merge & version.isNotNull(), F.struct(version, -seq))).alias(f"__a{i}"),
            F.max_by(cell, F.when((merge & version.isNull()) | ((op == "delete") & touches), seq)).alias(f"__b{i}"),
        ]
    both = old.join(recent.groupBy("external_id").agg(*aggs), "external_id", "full_outer")
    # The largest incoming version is not above the stored one: then no versioned write counts.
    fresh = lambda c, stored: F.when(stored.isNull() | (c["version"] > stored), c)
    # The later of two candidates; max of structs would compare values, so the order is the seq alone.
    later = lambda a, b: F.when(a.isNull() | (b["seq"] > a["seq"]), F.coalesce(b, a)).otherwise(a)
    both = both.withColumn("__rv", fresh(F.col("__rv"), F.col("doc_version"))).withColumn("__wipe", later(F.col("__rv"), F.col("__ru")))
    wipe, cells, versions = F.col("__wipe"), [], []
    for i, n in enumerate(names):
        own = F.col(f"cell_versions.`{n}`")
        top = fresh(F.col(f"__a{i}"), own)
        last = later(top, F.col(f"__b{i}"))
        base = F.when(wipe.isNotNull(), F.col(f"__wipe.doc.`{n}`")).otherwise(F.col(f"`{n}`"))
        newer = last.isNotNull() & (wipe.isNull() | (last["seq"] > wipe["seq"]))
        cells.append(F.when(newer, last["v"]).otherwise(base).alias(n))
        versions.append(F.coalesce(top["version"], own).alias(n))
    out = both.select("external_id", *cells, F.coalesce(F.col("__rv.version"), F.col("doc_version")).alias("doc_version"), F.struct(*versions).alias("cell_versions"))
    some = F.col("doc_version").isNotNull()
    for n in names:
        some = some | F.col(f"`{n}`").isNotNull() | F.col(f"cell_versions.`{n}`").isNotNull()
    return out.where(some)


def outcomes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(seq, external_id, outcome) of the replaces: 'ok', or 'dropped' where a version came too late.

    A running maximum a document, over its versioned replaces since the last unindex."""
    from pyspark.sql import Window

    stored = state.select("external_id", F.col("doc_version").alias("__dv"))
    rows = changes.where(F.col("op").isin("replace", "unindex"))
    per = Window.partitionBy("external_id").orderBy("seq")
    epoch = F.sum(F.when(F.col("op") == "unindex", 1).otherwise(0)).over(per.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__e", epoch).where(F.col("op") == "replace").join(stored, "external_id", "left")
    before = F.max("version").over(Window.partitionBy("external_id", "__e").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    top = F.greatest(before, F.when(F.col("__e") == 0, F.col("__dv")))
    late = F.col("version").isNotNull() & top.isNotNull() & (F.col("version") <= top)
    return rows.select("seq", "external_id", F.when(late, "dropped").otherwise("ok").alias("outcome"))


def unchanged(state: DataFrame, replaces: DataFrame, schema: CollectionSchema) -> DataFrame:
    """(external_id, written, skipped): how many fields a replace would write, and how many hold that value already."""
    old = state.select("external_id", F.struct(*schema.fields).alias("__old"))
    both = replaces.join(old, "external_id", "left")
    same = [F.col(f"fields.`{n}`").isNotNull() & F.col(f"fields.`{n}`").eqNullSafe(F.col(f"__old.`{n}`")) for n in schema.fields]
    given = [F.col(f"fields.`{n}`").isNotNull() for n in schema.fields]
    count = lambda cs: sum((c.cast("int") for c in cs), F.lit(0))
    return both.select("external_id", (count(given) - count(same)).alias("written"), count(same).alias("skipped"))
