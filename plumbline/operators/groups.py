"""Groups of hits or documents: collapse, duplicates and statistics of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyze
from ..schema import CollectionSchema


def collapse_to_values(hits: DataFrame, field: str) -> DataFrame:
    """One hit a distinct value, named by it, with the best score among its members; hits without a value go."""
    best = hits.where(F.col(field).isNotNull()).groupBy(field).agg(F.max("score").alias("score"))
    return best.select(F.col(field).cast("string").alias("external_id"), "score")


def collapse_to_first(hits: DataFrame, field: str, order: list[Column]) -> DataFrame:
    """One hit a distinct value: the first under the order, with its own id. Hits without a value stay, each alone.

    `order` are columns that sort ascending, so the first of a group is a minimum, which aggregates before it moves."""
    kept = [F.col(c) for c in hits.columns]
    lead = hits.where(F.col(field).isNotNull()).groupBy(field).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("first"))
    names = [F.col(f"first.`{c}`").alias(c) for c in hits.columns]
    alone = hits.where(F.col(field).isNull())
    return lead.select(*names).unionByName(alone).withColumn("collapse_key", F.col(field))


def values_of(rows: DataFrame, schema: CollectionSchema, field: str) -> DataFrame:
    """(external_id, value): one row a document and distinct value; documents without a value have none."""
    if schema[field].stored == "set":
        return rows.select("external_id", F.explode(F.array_distinct(field)).alias("value")).where(F.col("value").isNotNull())
    return rows.where(F.col(field).isNotNull()).select("external_id", F.col(field).alias("value"))


def shared_values(rows: DataFrame, schema: CollectionSchema, field: str, least: int) -> DataFrame:
    """(value, n) of the values that `least` documents hold, two at least."""
    schema.need(field, "duplicates")
    counted = values_of(rows, schema, field).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= max(2, least))


def json_text(value: Column, kind: str) -> Column:
    """The value as JSON text; text order of it is the tie-break of duplicate groups."""
    if kind in ("number", "int64", "decimal", "boolean"):
        return value.cast("string")
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def duplicates(rows: DataFrame, schema: CollectionSchema, field: str, least: int = 2, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page of groups (value, size, ids, position), all groups (value, n)).

    Sizes decide the page first; ids are gathered only for the values on it. A group's ids are one row: a caller who
    needs groups of any size uses `duplicate_members`, which keeps a row an id."""
    every = shared_values(rows, schema, field, least)
    order = [F.desc("n"), json_text(F.col("value"), schema[field].stored)]
    page = every.orderBy(*order).offset(offset).limit(limit)
    # At most `limit` values, the bound that makes the broadcast safe.
    held = values_of(rows, schema, field).join(F.broadcast(page), "value")
    groups = held.groupBy("value").agg(F.first("n").alias("size"), F.sort_array(F.collect_list("external_id")).alias("ids"))
    return groups, every


def duplicate_members(rows: DataFrame, schema: CollectionSchema, field: str, least: int = 2) -> DataFrame:
    """(value, n, external_id): a row for every document of every group."""
    return values_of(rows, schema, field).join(shared_values(rows, schema, field, least), "value").select("value", "n", "external_id")


def statistics(rows: DataFrame, schema: CollectionSchema) -> DataFrame:
    """(field, documents, unique_terms, avg_doc_len): a row a field; terms are distinct values, or tokens of texts.

    Fields are aggregated each by itself, so Spark reads only its column and combines before it shuffles."""
    out = None
    for name, spec in schema.fields.items():
        c = F.col(name)
        if spec.stored == "text":
            tok = rows.where(c.isNotNull()).select(analyze(c, spec.analyzer).alias("t"))
            lens = tok.agg(F.count(F.lit(1)).alias("documents"), F.avg(F.size("t")).alias("avg_doc_len"))
            terms = tok.select(F.explode(F.array_distinct("t")).alias("v")).agg(F.count_distinct("v").alias("unique_terms"))
            one = lens.withColumn("unique_terms", terms.scalar())
        elif spec.stored == "vector":
            one = rows.agg(F.count(c).alias("documents")).withColumn("unique_terms", F.lit(0).cast("long")).withColumn("avg_doc_len", F.lit(None).cast("double"))
        else:
            vals = values_of(rows, schema, name)
            one = vals.agg(F.count_distinct("value").alias("unique_terms")).withColumn("documents", rows.agg(F.count(c)).scalar()).withColumn("avg_doc_len", F.lit(None).cast("double"))
        one = one.select(F.lit(name).alias("field"), F.col("documents").cast("long"), F.col("unique_terms").cast("long"), "avg_doc_len")
        out = one if out is None else out.unionByName(one)
    return out


def coverage_audit(rows: DataFrame, schema: CollectionSchema, expected: dict[str, int]) -> DataFrame:
    """(field, expected, found): fields that should hold documents but have fewer values than that."""
    counts = rows.agg(*[F.count(F.col(n)).alias(n) for n in schema.fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(int(expected.get(n, 0))).cast("long").alias("expected"), F.col(n).alias("found")) for n in schema.fields]))
    return counts.select(pairs.alias("x")).select("x.*").where(F.col("found") < F.col("expected"))
