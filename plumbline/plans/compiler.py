"""A query tree as a Spark plan: rows with one nullable score column, where null means no match.

Everything that depends on the row alone becomes one expression, so Catalyst sees a single projection. What needs other
rows is planned around it: corpus statistics are scalar subqueries, child queries become semi or anti joins (or a flag
where they stand deeper), kNN takes its k from the rows the rest of its `and` allows. Ahead of all of it stands a plain
predicate that every hit must satisfy, because predicates reach the Parquet scan and scores do not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import values
from ..functions.text import analyze
from ..operators import fusion, groups, lexical, nearest
from ..schema import CollectionSchema
from . import nodes as N

SCORE = "__score"
#: Literal lists of ids up to this length are a set in the predicate; longer ones are joined.
MOST_IDS = 10_000


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row. A filter above it stays above it: as a plain projection the
    expression would be copied into the filter and into every use."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _none() -> Column:
    return F.lit(None).cast("double")


class Compiler:
    """One tree over one collection. `base` are the live rows the query may hit; statistics come from `corpus`."""

    def __init__(self, base: DataFrame, schema: CollectionSchema, children: Callable[[str], tuple[DataFrame, CollectionSchema]], corpus: DataFrame | None = None, digits: int | None = None, indexes=None):
        self.indexes = indexes
        self.base, self.schema, self.children, self.digits = base, schema, children, digits
        self.corpus = base if corpus is None else corpus
        self.rows = base
        self.names = 0
        self.tokens: dict[str, Column] = {}
        self.stats: dict[str, tuple[Column, dict]] = {}

    def scored(self, root: N.Node) -> DataFrame:
        """All hits: the collection's columns and `__score`."""
        N.check_limits(root)
        must = self.necessary(root)
        if must is not None:
            self.rows = self.rows.where(must)
        self.collect_tokens(root)
        score = self.column(root, top=True)
        score = score if self.digits is None else F.round(score, self.digits)
        out = once(self.rows, SCORE, score).where(F.col(SCORE).isNotNull())
        return out.select(*[F.col(f"`{c}`") for c in self.base.columns], SCORE)

    def name(self) -> str:
        self.names += 1
        return f"__c{self.names}"

    # Leaves that are a predicate of the row.

    def literal(self, field: str, value, bound: bool = False):
        """A request's value as the field's type; a wrong type is an error, never an empty result."""
        spec = self.schema[field]
        kind = spec.stored
        if kind in ("keyword", "set"):
            if not isinstance(value, str):
                raise QueryError("type_mismatch", f"field {field!r} takes strings")
            return F.lit(value)
        if kind == "number":
            return F.lit(values.number_literal(value, bound))
        if kind == "int64":
            if isinstance(value, bool) or not isinstance(value, int):
                raise QueryError("type_mismatch", f"field {field!r} takes whole numbers")
            return F.lit(value).cast("long")
        if kind == "decimal":
            return F.lit(values.decimal_literal(value, spec.precision, spec.scale))
        if kind == "boolean":
            if not isinstance(value, bool):
                raise QueryError("type_mismatch", f"field {field!r} takes true or false")
            return F.lit(value)
        if kind in ("date", "timestamp"):
            if not isinstance(value, str):
                raise QueryError("type_mismatch", f"field {field!r} takes strings")
            return F.lit(value).cast(spec.spark_type)
        raise QueryError("type_mismatch", f"field {field!r} of type {kind} has no exact values")

    def predicate(self, node: N.Node) -> Column | None:
        """The condition of a constant leaf; None for other nodes."""
        if isinstance(node, N.Term):
            spec = self.schema.need(node.field, "exact")
            v = self.literal(node.field, node.value)
            return F.array_contains(node.field, v) if spec.stored == "set" else F.col(node.field) == v
        if isinstance(node, N.Terms):
            spec = self.schema.need(node.field, "exact")
            vs = [self.literal(node.field, v) for v in node.values]
            if not vs:
                return F.lit(False)
            return F.arrays_overlap(F.col(node.field), F.array(*vs)) if spec.stored == "set" else F.col(node.field).isin(vs)
        if isinstance(node, N.Prefix):
            self.schema.need(node.field, "prefix")
            return F.col(node.field).startswith(node.value)
        if isinstance(node, N.Ids) and len(node.values) <= MOST_IDS:
            return F.col("external_id").isin(list(node.values)) if node.values else F.lit(False)
        if isinstance(node, N.Exists):
            spec = self.schema.need(node.field, "exists")
            c = F.col(node.field)
            return c.isNotNull() & (F.size(c) > 0) if spec.stored == "set" else c.isNotNull()
        if isinstance(node, N.Range):
            self.schema.need(node.field, "range")
            c = F.col(node.field)
            cond = c.isNotNull()
            low, high = (node.gte, True) if node.gte is not None else (node.gt, False), (node.lte, True) if node.lte is not None else (node.lt, False)
            if low[0] is not None:
                v = self.literal(node.field, low[0], bound=True)
                cond = cond & ((c >= v) if low[1] else (c > v))
            if high[0] is not None:
                v = self.literal(node.field, high[0], bound=True)
                cond = cond & ((c <= v) if high[1] else (c < v))
            return cond
        return None

    def necessary(self, node: N.Node) -> Column | None:
        """A condition of the row that every hit of the node satisfies, as far as there is one."""
        p = self.predicate(node)
        if p is not None:
            return p
        if isinstance(node, N.Hamming):
            return self.distance(node) <= min(node.max_distance, 64)
        if isinstance(node, (N.Match, N.Phrase, N.Fuzzy)):
            spec = self.schema.need(node.field, "match")
            if self.index_of(node) is not None:
                return None
            c = F.col(node.field)
            if spec.analyzer != "whitespace_lower" or isinstance(node, N.Fuzzy):
                return c.isNotNull()
            # A word is a piece of the lower-cased text: looking for it there is far cheaper than cutting the text up.
            held = [F.lower(c).contains(t) for t, _ in dict.fromkeys(self.wanted(node))]
            some = isinstance(node, N.Match) and node.op == "or"
            return reduce(lambda a, b: (a | b) if some else (a & b), held) if held else F.lit(False)
        if isinstance(node, N.Not):
            p = self.predicate(node.clause)
            return None if p is None else ~F.coalesce(p, F.lit(False))
        if isinstance(node, N.And):
            # A kNN beside other clauses sees what they allow; these predicates are part of that.
            have = [c for c in map(self.necessary, node.clauses) if c is not None]
            return reduce(lambda a, b: a & b, have) if have else None
        if isinstance(node, N.Or):
            have = [self.necessary(c) for c in node.clauses]
            return reduce(lambda a, b: a | b, have) if have and all(c is not None for c in have) else None
        if isinstance(node, N.Bool):
            return self.necessary(N.And(node.must)) if node.must else None
        return None

    # Scores.

    def column(self, node: N.Node, top: bool = False) -> Column:
        """The node's score for each row of `rows`, to which it may add helper columns. `top`: every hit of the
        request must match this node, so rows that do not may go at once."""
        p = self.predicate(node)
        if p is not None:
            return F.when(p, F.lit(1.0))
        if isinstance(node, N.Ids):
            return self.long_ids(node, top)
        if isinstance(node, N.And):
            return self.conjunction(node, top)
        if isinstance(node, N.Or):
            return lexical.add_up([self.column(c) for c in node.clauses], every=False)
        if isinstance(node, N.Not):
            return F.when(self.column(node.clause).isNull(), F.lit(1.0))
        if isinstance(node, N.Bool):
            return self.lexical_bool(node)
        if isinstance(node, (N.Match, N.Phrase, N.Fuzzy)):
            return self.lexical_score(node, top)
        if isinstance(node, N.Hamming):
            d = self.distance(node)
            return F.when(d <= min(node.max_distance, 64), (64 - d) / 64.0)
        if isinstance(node, N.Knn):
            return self.nearest(node, self.base, top)
        if isinstance(node, N.Duplicated):
            return self.duplicated(node, top)
        if isinstance(node, N.HasChild):
            return self.only_with(node, "left_semi") if top else self.child_flag(node)
        if isinstance(node, N.Rrf):
            return self.fused(node, top)
        raise QueryError("bad_request", f"cannot run {type(node).__name__}")

    def conjunction(self, node: N.And, top: bool) -> Column:
        near = [c for c in node.clauses if isinstance(c, N.Knn)]
        rest = [c for c in node.clauses if not isinstance(c, N.Knn)]
        if not node.clauses:
            return _none()
        parts = []
        if rest:
            parts.append(self.sum_of_all(rest, top))
        if near:
            allowed = self.base
            if rest and not top:
                # What stands around this `and` must not narrow what its kNN sees.
                allowed = self.apart(N.And(tuple(rest)))
            elif rest:
                gate = self.name()
                self.rows = self.rows.withColumn(gate, parts[0])
                parts = [F.col(gate)]
                allowed = self.rows.where(F.col(gate).isNotNull())
            parts += [self.nearest(c, allowed, top) for c in near]
        return lexical.add_up(parts, every=True)

    def apart(self, node: N.Node) -> DataFrame:
        """The rows of the whole base that match a node."""
        return Compiler(self.base, self.schema, self.children, self.corpus, self.digits, self.indexes).scored(node)

    def sum_of_all(self, clauses: list[N.Node], top: bool) -> Column:
        parts = []
        for c in clauses:
            if top and isinstance(c, N.Not) and isinstance(c.clause, N.HasChild):
                parts.append(self.only_with(c.clause, "left_anti"))
            else:
                # A kNN further down must see what its own `and` allows, not what this one does.
                inside = not (isinstance(c, N.And) and any(isinstance(x, N.Knn) for x in c.clauses))
                parts.append(self.column(c, top=top and inside))
        # With nothing but negations the sum starts from the universe, which scores 1 itself.
        if all(isinstance(c, N.Not) for c in clauses):
            parts.append(F.lit(1.0))
        return lexical.add_up(parts, every=True)

    def lexical_bool(self, node: N.Bool) -> Column:
        if any(isinstance(x, N.Knn) for x, _ in N.walk(node)):
            raise QueryError("bad_request", "knn cannot stand inside bool; use rrf")
        must, should = [self.column(c) for c in node.must], [self.column(c) for c in node.should]
        if not must and not should and node.least == 0:
            total, enough = F.lit(1.0), F.lit(True)
        else:
            total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in must + should], F.lit(0.0))
            enough = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in should], F.lit(0)) >= node.least
        for c in must:
            enough = enough & c.isNotNull()
        for c in node.must_not:
            enough = enough & self.column(c).isNull()
        return F.when(enough, total)

    # Text.

    def wanted(self, node: N.Node) -> list[tuple[str, int]]:
        """The (token, edits) that a lexical node asks for, repeats kept."""
        spec = self.schema.need(node.field, "match")
        spark = self.base.sparkSession
        if isinstance(node, N.Fuzzy):
            found = lexical.query_tokens(spark, node.value, spec.analyzer)
            return [(t, node.max_edits) for t in found]
        return [(t, 0) for t in lexical.query_tokens(spark, node.text, spec.analyzer)]

    def collect_tokens(self, root: N.Node) -> None:
        """Tokens once a field and row, and one statistics subquery a field for all its query tokens."""
        by_field: dict[str, dict] = {}
        todo = [root]
        while todo:
            node = todo.pop()
            if isinstance(node, (N.Match, N.Phrase, N.Fuzzy)) and self.index_of(node) is None:
                by_field.setdefault(node.field, {}).update(dict.fromkeys(self.wanted(node)))
            elif not isinstance(node, (N.Rrf, N.Match, N.Phrase, N.Fuzzy)):  # its legs are queries of their own
                todo += node.children
        for field, index in by_field.items():
            spec = self.schema[field]
            if not index:
                continue
            index = {w: i for i, w in enumerate(index)}
            read = self.corpus.where(F.col(field).isNotNull()).select(field)
            row = once(read, "__t", analyze(F.col(field), spec.analyzer)).select("__t")
            tok, stat = self.name(), self.name()
            self.rows = once(self.rows, tok, analyze(F.col(field), spec.analyzer)).withColumn(stat, lexical.statistics(row, list(index)))
            self.tokens[field] = F.col(tok)
            self.stats[field] = (F.col(stat), index)

    def index_of(self, node: N.Node):
        return self.indexes.get(node.field) if self.indexes else None

    def lexical_score(self, node: N.Node, top: bool = False) -> Column:
        wanted = self.wanted(node)
        if not wanted:
            return _none()
        every = isinstance(node, N.Phrase) or getattr(node, "op", "or") == "and"
        if (index := self.index_of(node)) is not None:
            return self.attach(index.hits(wanted, every, isinstance(node, N.Phrase)), few=False, top=top)
        tok, (stats, index) = self.tokens[node.field], self.stats[node.field]
        parts = [lexical.contribution(lexical.count_of(tok, *w), F.size(tok), stats, index[w]) for w in wanted]
        total = lexical.add_up(parts, every=every)
        if isinstance(node, N.Phrase) and len(wanted) > 1:
            total = F.when(lexical.has_phrase(tok, [w for w, _ in wanted]), total)
        return total

    # Nodes that need other rows.

    def distance(self, node: N.Hamming) -> Column:
        self.schema.need(node.field, "hamming")
        return values.hamming(values.hash_bits(F.col(node.field)), values.hash_literal(node.hash))

    def attach(self, found: DataFrame, few: bool, top: bool, on: str = "external_id") -> Column:
        """The score of (key, score) rows for each row; `few` where their number has a proven bound. Rows without one
        go where every hit must have it."""
        key, score = self.name(), self.name()
        side = found.select(F.col(found.columns[0]).alias(key), F.col(found.columns[1]).alias(score))
        side = F.broadcast(side) if few else side
        self.rows = self.rows.join(side, self.rows[on] == F.col(key), "inner" if top else "left").drop(key)
        return F.col(score)

    def nearest(self, node: N.Knn, allowed: DataFrame, top: bool) -> Column:
        spec = self.schema.need(node.field, "nearest")
        vector = nearest.check(node.vector, spec.dim)
        if not node.k:
            return _none()
        if spec.quantize == "sq":
            from ..functions.vectors import quantize

            # The range is that of all the collection's vectors, whatever a filter leaves.
            allowed = quantize(allowed, node.field, node.field, self.corpus)
        found = nearest.top_k(allowed, node.field, vector, spec.metric, node.k, self.digits)
        return self.attach(found, few=True, top=top)  # k rows, MAX_K at most

    def long_ids(self, node: N.Ids, top: bool) -> Column:
        ids = self.base.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(node.values)], "id string")
        return self.attach(ids.withColumn("s", F.lit(1.0)), few=False, top=top)

    def duplicated(self, node: N.Duplicated, top: bool) -> Column:
        shared = groups.shared_values(self.corpus, self.schema, node.field, node.min_group_size)
        if self.schema[node.field].stored != "set":
            return self.attach(shared.select("value", F.lit(1.0).alias("s")), few=False, top=top, on=node.field)
        held = groups.values_of(self.corpus, self.schema, node.field).join(shared, "value", "left_semi")
        return self.attach(held.select("external_id").distinct().withColumn("s", F.lit(1.0)), few=False, top=top)

    def child_keys(self, node: N.HasChild) -> DataFrame:
        """The parent ids that matching children name, repeats kept."""
        rows, schema = self.children(node.collection)
        if schema[node.field].stored != "keyword":
            raise QueryError("type_mismatch", f"field {node.field!r} must be a keyword")
        hits = Compiler(rows, schema, self.children).scored(node.query)
        return hits.where(F.col(node.field).isNotNull()).select(F.col(node.field).alias(self.name()))

    def only_with(self, node: N.HasChild, how: str) -> Column:
        """Keeps the rows with (or without) such a child, which then score alike; repeats of a key cost nothing."""
        keys = self.child_keys(node)
        self.rows = self.rows.join(keys, self.rows["external_id"] == keys[keys.columns[0]], how)
        return F.lit(1.0)

    def child_flag(self, node: N.HasChild) -> Column:
        return self.attach(self.child_keys(node).distinct().withColumn("s", F.lit(1.0)), few=False, top=False)

    def fused(self, node: N.Rrf, top: bool) -> Column:
        if not node.queries:
            return _none()
        ranked, few = [], True
        for q in node.queries:
            leg = self.apart(q).select("external_id", F.col(SCORE).alias("score"))
            bounded = isinstance(q, N.Knn)
            few = few and bounded
            ranked.append(fusion.rank_few(leg) if bounded else fusion.rank_many(leg))
        return self.attach(fusion.fuse(ranked, node.k), few=few, top=top)
