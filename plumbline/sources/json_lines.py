"""Line-delimited JSON: documents or change items, with the lines that do not fit kept apart instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..schema import CollectionSchema, FieldSpec

_BAD = "__bad"


def _wire(spec: FieldSpec) -> T.DataType:
    """The type a field is read with; those with rules of their own are read as text and checked."""
    return T.StringType() if spec.stored in ("date", "timestamp", "decimal", "hash") else spec.spark_type


def checked(raw: DataFrame, schema: CollectionSchema) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of rows in wire types: dates, decimals, hashes, vector lengths and finite numbers are
    checked, empty lists are missing values, sets lose repeats. A reject has the id and the fields at fault."""
    out, faults = [F.col("external_id")], []
    for name, spec in schema.fields.items():
        c = F.col(f"`{name}`")
        kind = spec.stored
        if kind == "date":
            v = values.strict_date(c)
            bad = c.isNotNull() & v.isNull()
        elif kind == "timestamp":
            v = F.try_to_timestamp(c)
            bad = c.isNotNull() & v.isNull()
        elif kind == "decimal":
            v = values.strict_decimal(c, spec.precision, spec.scale)
            bad = c.isNotNull() & v.isNull()
        elif kind == "hash":
            v, bad = c, c.isNotNull() & values.hash_bits(c).isNull()
        elif kind == "number":
            v, bad = c, F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        elif kind == "vector":
            v, bad = c, c.isNotNull() & ((F.size(c) != spec.dim) | F.exists(c, lambda x: x.isNull() | F.isnan(x)))
        elif kind == "set":
            v = F.when(F.size(c) > 0, F.array_distinct(c))
            bad = F.exists(c, lambda x: x.isNull())
        else:
            v, bad = c, F.lit(False)
        out.append(v.alias(name))
        faults.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    at_fault = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")
    at_fault = F.when(F.col("external_id").isNull() | (F.col("external_id") == ""), F.array(F.lit("external_id"))).otherwise(at_fault)
    marked = raw.withColumn(_BAD, at_fault)
    good = marked.where(F.size(_BAD) == 0).select(*out)
    rejects = marked.where(F.size(_BAD) > 0).select("external_id", F.col(_BAD).alias("fields"), F.lit("type_mismatch").alias("code"))
    return good, rejects


def read_documents(spark: SparkSession, path: str, schema: CollectionSchema) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): one JSON object a line with external_id and the fields. Lines that do not parse are among
    the rejects, whole."""
    wire = T.StructType([T.StructField("external_id", T.StringType()), *[T.StructField(n, _wire(s)) for n, s in schema.fields.items()], T.StructField("__line", T.StringType())])
    raw = spark.read.schema(wire).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line").json(path)
    good, rejects = checked(raw.where(F.col("__line").isNull()), schema)
    broken = raw.where(F.col("__line").isNotNull()).select("external_id", F.array(F.lit("*")).alias("fields"), F.lit("bad_request").alias("code"), F.col("__line").alias("line"))
    return good, rejects.withColumn("line", F.lit(None).cast("string")).unionByName(broken)


def write_hits(hits: DataFrame, path: str) -> None:
    """Hits as JSON lines."""
    hits.write.mode("overwrite").json(path)
