"""Lexical scoring (BM25) as columns over an array of tokens and one row of corpus statistics.

The statistics are those of the whole collection, whatever a request filters, and come as a scalar subquery: one
aggregation for all tokens that a request asks of a field, planned lazily with the query itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import analyze

# Saturation and length normalisation.
K1, B = 1.2, 0.75


_known: dict[tuple[str, str], list[str]] = {}


def query_tokens(spark: SparkSession, text: str, analyzer: str) -> list[str]:
    """The tokens of a query text by the field's own analyzer. Folded on the driver as a local relation: no job."""
    key = (text, analyzer)
    if key not in _known:
        if len(_known) >= 1000:
            _known.clear()
        one = spark.sql("SELECT t FROM VALUES (:q) AS v(t)", args={"q": text})
        _known[key] = list(one.select(analyze(F.col("t"), analyzer).alias("x")).first()["x"] or [])
    return list(_known[key])


def near(token: Column, term: str, edits: int) -> Column:
    return F.levenshtein(token, F.lit(term), edits) >= 0 if edits else token == F.lit(term)


def count_of(tokens: Column, term: str, edits: int = 0) -> Column:
    return F.size(F.filter(tokens, lambda x: near(x, term, edits)))


def has(tokens: Column, term: str, edits: int = 0) -> Column:
    return F.exists(tokens, lambda x: near(x, term, edits)) if edits else F.array_contains(tokens, term)


def has_phrase(tokens: Column, terms: list[str]) -> Column:
    n = len(terms)
    at = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return (F.size(tokens) >= n) & F.exists(at, lambda i: F.slice(tokens, i, n) == F.array(*map(F.lit, terms)))


def statistics(tokens: DataFrame, wanted: list[tuple[str, int]]) -> Column:
    """(n, total, df_0, df_1, ...) of the one-column DataFrame of token arrays, as a scalar struct. Rows are the
    documents that have a value, with tokens or without."""
    t = F.col(tokens.columns[0])
    sums = [F.sum(F.when(has(t, term, edits), 1).otherwise(0)).alias(f"df_{i}") for i, (term, edits) in enumerate(wanted)]
    row = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(t)).alias("total"), *sums)
    return row.select(F.struct(*row.columns)).scalar()


def contribution(tf: Column, length: Column, stats: Column, i: int) -> Column:
    """What token i adds to a document's score; null where it does not occur."""
    n, df = stats["n"].cast("double"), stats[f"df_{i}"].cast("double")
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    norm = 1.0 - B + F.try_divide(B * length * n, stats["total"].cast("double"))
    return F.when(tf > 0, idf * tf * (K1 + 1.0) / (tf + K1 * norm))


def add_up(parts: list[Column], every: bool) -> Column:
    """Sum of the parts that are there; null unless any (or every) part is."""
    if not parts:
        return F.lit(None).cast("double")
    there = parts[0].isNotNull()
    total = F.coalesce(parts[0], F.lit(0.0))
    for p in parts[1:]:
        there = (there & p.isNotNull()) if every else (there | p.isNotNull())
        total = total + F.coalesce(p, F.lit(0.0))
    return F.when(there, total)
