"""Postings files: an inverted index of a text field, so that a query reads the rows of its own tokens only.

The index is made of segments: each task cuts its own documents into runs of about `SEGMENT` tokens, inverts every run
and writes it as rows (token, n, ids, tf, dl, positions) in the order of tokens, one row for each token of the run. Nothing is
shuffled, sorted on disk or read twice, so that an index costs as much as its table is large. Pages of Parquet hold few rows, and
their ranges of tokens (the column index) let a query read its own tokens' pages alone; a frequent token has a row in
every segment and is read by many tasks. A row without a token tells a segment's documents and tokens.
A collection that has an index answers its lexical nodes from it (see `Postings` and `Collection.indexed`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import analyze
from ..operators import lexical
from ..plans.nodes import Match

#: Tokens inverted at once, more only where one document has more.
SEGMENT = 1_000_000
#: Rows of a Parquet page, and of what Python hands over at once.
PAGE_ROWS, HANDED = 256, 4096
#: Terms near a fuzzy one that are looked up by name; more are joined.
MOST_TERMS = 1_000
_ROWS = "token string, n int, ids array<string>, tf array<int>, dl array<int>, positions array<array<int>>"


def build(collection, field: str, path: str) -> None:
    write(collection.tokens(field), path)


def write(tokens: DataFrame, path: str) -> None:
    """Write the index of (external_id, tokens)."""
    rows = tokens.select(F.col("external_id").cast("string"), "tokens").mapInArrow(_segments, _ROWS)
    rows.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/segments")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy())
        at = 0
        while at < len(b):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SEGMENT - size, side="right")))
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= SEGMENT or at < len(b):
                yield from _inverted(held)
                held, size = [], 0
    if held:
        yield from _inverted(held)


def _inverted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: first the one without a token, then the tokens in order."""
    ids, lists = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
    dl = lists.value_lengths().fill_null(0).to_numpy().astype(np.int32)
    words = lists.flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary)  # by bytes, as Spark and Parquet compare
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    key = rank[words.indices.to_numpy()] << 32 | np.arange(len(words))
    key.sort()
    token, at = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    del key
    doc = np.repeat(np.arange(len(dl), dtype=np.int32), dl)[at]
    place = at - (np.cumsum(dl) - dl).astype(np.int32)[doc]
    new = np.ones(len(at), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)  # of each posting
    token, doc = token[first], doc[first]
    ends = np.r_[first, len(at)].astype(np.int32)
    edge = np.searchsorted(token, np.arange(len(order) + 1, dtype=np.int32)).astype(np.int32)  # of each token
    lead = pa.array(np.r_[0, edge])  # the row without a token is empty
    inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(place))
    of = lambda values: pa.ListArray.from_arrays(lead, values)
    total = pa.array([[int(dl.sum())]], pa.list_(pa.int32()))
    tf = of(pa.array(np.diff(ends)))
    rows = pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array([None], pa.string()), words.dictionary.take(order).cast(pa.string())]), pa.array(np.r_[len(dl), np.diff(edge)].astype(np.int32)),
            of(ids.take(pa.array(doc)).cast(pa.string())), pa.concat_arrays([total, tf.slice(1)]), of(pa.array(dl[doc])), of(inner),
        ], ["token", "n", "ids", "tf", "dl", "positions"],
    )
    for k in range(0, len(rows), HANDED):
        yield rows.slice(k, HANDED)


class Postings:
    """The index at a path. It is that of one version of the rows; whoever changes them writes another."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @cached_property
    def segments(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/segments")

    def posts(self, mine: DataFrame, places: bool) -> DataFrame:
        """(token, external_id, tf, dl, positions) of rows of segments; positions are null unless asked for, and then not read."""
        each = ["ids", "tf", "dl", *(["positions"] if places else [])]
        held = F.col("x.positions") if places else F.lit(None).cast("array<int>")
        return mine.select("token", F.explode(F.arrays_zip(*each)).alias("x")).select("token", F.col("x.ids").alias("external_id"), "x.tf", "x.dl", held.alias("positions"))

    @cached_property
    def corpus(self) -> tuple[int, int]:
        """How many documents have a value, and how many tokens those hold: one sum, read once."""
        row = self.segments.where(F.col("token").isNull()).agg(F.sum("n"), F.sum(F.get("tf", F.lit(0)).cast("long"))).first()
        return row[0] or 0, row[1] or 0

    def hits(self, wanted: list[tuple[str, int]], every: bool, phrase: bool = False) -> DataFrame:
        """(external_id, score) of the documents that hold any (or every) one of the (token, edits) wanted; a repeated
        one counts again. `phrase`: only where they stand one behind the other."""
        index = list(dict.fromkeys(wanted))
        weight = Counter(wanted)
        number = {w: i for i, w in enumerate(index)}
        legs = [self._exact([w for w in index if not w[1]], number, weight, phrase)] if any(not e for _, e in index) else []
        legs += [self._near(w, number[w], weight[w]) for w in index if w[1]]
        parts = legs[0]
        for leg in legs[1:]:
            parts = parts.unionByName(leg)
        if len(index) == 1 and not (phrase and len(wanted) > 1):
            return parts.select("external_id", F.col("part").alias("score"))
        # Parts are added in the order of the query's tokens, so that the sum does not depend on the order of rows.
        take = lambda i, c: F.max(F.when(F.col("at") == i, F.col(c)))
        cols = [take(i, "part").alias(f"p{i}") for i in range(len(index))]
        places = [take(i, "positions").alias(f"q{i}") for i in range(len(index))] if phrase else []
        found = parts.groupBy("external_id").agg(F.count(F.lit(1)).alias("m"), *cols, *places)
        if every or phrase:
            found = found.where(F.col("m") == len(index))
        if phrase:
            behind = lambda p: reduce(and_, [F.array_contains(f"q{number[w]}", p + k) for k, w in enumerate(wanted) if k])
            found = found.where(F.exists(f"q{number[wanted[0]]}", behind))
        return found.select("external_id", lexical.add_up([F.col(f"p{i}") for i in range(len(index))], every=False).alias("score"))

    def _stats(self, df: DataFrame) -> Column:
        """The corpus numbers beside a row of document frequencies, as one scalar struct."""
        n, total = self.corpus
        return df.select(F.struct(F.lit(n).alias("n"), F.lit(total).alias("total"), *df.columns)).scalar()

    def _exact(self, index: list[tuple[str, int]], number: dict, weight: Counter, places: bool) -> DataFrame:
        words = [t for t, _ in index]
        mine = self.segments.where(F.col("token").isin(words))
        df = mine.agg(*[F.coalesce(F.sum(F.when(F.col("token") == t, F.col("n"))), F.lit(0)).alias(f"df_{i}") for i, t in enumerate(words)])
        out = self.posts(mine, places).withColumn("s", self._stats(df))
        part = at = None
        for i, w in enumerate(index):
            is_it = F.col("token") == w[0]
            one = lexical.contribution(F.col("tf"), F.col("dl"), F.col("s"), i) * float(weight[w])
            part = F.when(is_it, one) if part is None else part.when(is_it, one)
            at = F.when(is_it, number[w]) if at is None else at.when(is_it, number[w])
        return out.select("external_id", at.alias("at"), part.alias("part"), "positions")

    def _near(self, w: tuple[str, int], at: int, weight: int) -> DataFrame:
        close = self.segments.where(lexical.near(F.col("token"), *w)).select("token").distinct()
        names = [r["token"] for r in close.limit(MOST_TERMS + 1).collect()]
        mine = self.segments.where(F.col("token").isin(names)) if len(names) <= MOST_TERMS else self.segments.join(close, "token", "left_semi")
        each = self.posts(mine, False).groupBy("external_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
        out = each.withColumn("s", self._stats(each.agg(F.count(F.lit(1)).alias("df_0"))))
        one = lexical.contribution(F.col("tf"), F.col("dl"), F.col("s"), 0) * float(weight)
        return out.select("external_id", F.lit(at).alias("at"), one.alias("part"), F.lit(None).cast("array<int>").alias("positions"))


class Indexes:
    """The indexes of a collection's text fields, each written when a query first needs it."""

    def __init__(self, rows: DataFrame, schema, fields: tuple[str, ...], new_path):
        self.rows, self.schema, self.fields, self.new_path = rows, schema, fields, new_path
        self.made: dict[str, Postings] = {}

    def get(self, field: str) -> Postings | None:
        if field not in self.fields:
            return None
        if field not in self.made:
            spec = self.schema.need(field, "match")
            path = self.new_path(self.rows.sparkSession, f"index-{field}")
            write(self.rows.where(F.col(field).isNotNull()).select("external_id", analyze(F.col(field), spec.analyzer).alias("tokens")), path)
            self.made[field] = Postings(self.rows.sparkSession, path)
        return self.made[field]


def search(spark: SparkSession, path: str, match: Match, analyzer: str = "whitespace_lower") -> DataFrame:
    """(external_id, score) of all hits of a match, from the postings alone."""
    tokens = lexical.query_tokens(spark, match.text, analyzer)
    index = Postings(spark, path)
    if not tokens:
        return index.posts(index.segments.where(F.lit(False)), False).select("external_id", F.lit(0.0).alias("score"))
    return index.hits([(t, 0) for t in tokens], every=match.op == "and")
