"""Collections: a DataFrame of documents under a declared schema, and everything that can be asked of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError
from .functions.text import analyze
from .operators import facets, groups, nearest
from .plans import paging
from .plans.compiler import SCORE, Compiler
from .plans.request import MAX_LIMIT, MAX_SEARCHES, Request, check_sort, parse
from .schema import CollectionSchema
from .sources.postings import Indexes
from .storage import new_path


@dataclass(frozen=True)
class Found:
    """The answer to a request, lazily: `hits` is the page (external_id, score and, with collapse that keeps ids,
    collapse_key; sorted pages carry their sort values), `matched` the whole match set."""

    request: Request
    hits: DataFrame
    matched: DataFrame
    schema: CollectionSchema
    groups: DataFrame | None = None

    def total(self) -> tuple[int, str] | None:
        """How many documents (or, for a plain collapse, groups) match, with the relation 'eq' or 'gte'."""
        plain = self.groups is not None and not self.request.keep_ids
        return paging.total(self.groups if plain else self.matched, self.request.track_total)

    def collapsed_total(self) -> int | None:
        return None if self.groups is None else self.groups.count()

    def page(self) -> tuple[list, str | None]:
        """The page's rows and the cursor behind it; None behind the last page."""
        rows = self.hits.collect()  # `limit` rows at most
        full = self.request.limit and len(rows) == self.request.limit
        return rows, paging.cursor_of(rows[-1], self.request) if full else None

    @cached_property
    def facets(self) -> dict[str, facets.Facet]:
        out = {}
        for name, f in self.request.facets.items():
            f = dict(f)
            kind = f.pop("kind", None)
            if kind not in ("terms", "range"):
                raise QueryError("bad_request", f"unknown facet kind {kind!r}")
            out[name] = (facets.terms if kind == "terms" else facets.ranges)(self.matched, self.schema, **f)
        return out

    @cached_property
    def metrics(self) -> DataFrame:
        return facets.metrics(self.matched, self.schema, self.request.metrics)


class Collection:
    """Documents with an `external_id` and the declared fields (all nullable); a row without any value is not live and
    must not be among them (writes see to that). Columns that are not declared are left out."""

    def __init__(self, rows: DataFrame, schema: CollectionSchema | Mapping, catalog=None, digits: int | None = None, indexes: Indexes | None = None):
        self.indexes = indexes
        self.schema = schema if isinstance(schema, CollectionSchema) else CollectionSchema.of(schema)
        missing = [n for n in ("external_id", *self.schema.fields) if n not in rows.columns]
        if missing:
            raise QueryError("unknown_field", f"the rows lack {', '.join(missing)}")
        self.rows = rows.select("external_id", *[F.col(f"`{n}`") for n in self.schema.fields])
        self.catalog = catalog
        self.digits = digits

    def indexed(self, *fields: str) -> Collection:
        """The same collection with postings of the text fields (all of them, if none is named). They are written to the
        shared folder when a query first needs them, and later queries read the rows of their tokens alone."""
        fields = fields or tuple(n for n, s in self.schema.fields.items() if s.stored == "text")
        return Collection(self.rows, self.schema, self.catalog, self.digits, Indexes(self.rows, self.schema, fields, new_path))

    def _child(self, name: str) -> tuple[DataFrame, CollectionSchema]:
        if self.catalog is None:
            raise QueryError("collection_not_found", f"no collection {name!r}")
        child = self.catalog[name]
        return child.rows, child.schema

    def matched(self, request: Request) -> DataFrame:
        """The whole match set of a request with `__score` (null for hits that only a filter selected)."""
        if not request.split:
            return Compiler(self.rows, self.schema, self._child, digits=self.digits, indexes=self.indexes).scored(request.query)
        rows = self.rows
        if request.filter is not None:
            rows = Compiler(rows, self.schema, self._child, indexes=self.indexes).scored(request.filter).drop(SCORE)
        if request.scoring is None:
            return rows.withColumn(SCORE, F.lit(None).cast("double"))
        return Compiler(rows, self.schema, self._child, corpus=self.rows, digits=self.digits, indexes=self.indexes).scored(request.scoring)

    def search(self, body: Mapping | Request, unlimited: bool = False) -> Found:
        """Run a request. `unlimited`: every hit, without the bounds of a page (see search_all)."""
        request = parse(body, unlimited)
        check_sort(request, self.schema)
        matched = self.matched(request)
        if request.collapse:
            return self._collapsed(request, matched, unlimited)
        hits = paging.select_for_sort(matched, request.sort)
        everything = hits
        cursor, offset = request.cursor, request.offset
        if cursor and "offset" in cursor:
            offset = cursor["offset"]
        elif cursor:
            hits = hits.where(paging.after(request.sort, cursor, self.schema))
        values = [F.col(k.field).alias(f"sort_{i}") for i, k in enumerate(request.sort)]
        by_field = request.sort and not request.split
        score = paging.sort_score(request.sort, self.schema) if by_field else F.col(SCORE)
        page = hits if unlimited and not request.sort else hits.orderBy(*paging.order_of(request.sort))
        if not unlimited:
            page = page.offset(offset).limit(request.limit) if offset else page.limit(request.limit)
        return Found(request, page.select("external_id", score.alias("score"), *values), everything, self.schema)

    def _collapsed(self, request: Request, matched: DataFrame, unlimited: bool) -> Found:
        spec = self.schema.need(request.collapse, "collapse")
        if not request.keep_ids and spec.stored != "keyword":
            raise QueryError("type_mismatch", "collapse needs a keyword field")
        scored = matched.withColumn("score", F.col(SCORE))
        if request.keep_ids:
            if request.sort:
                raise QueryError("unsupported_sort", "collapse keeps the best hit by score")
            order = [-F.coalesce(F.col("score"), F.lit(0.0)), F.col("external_id")]
            groups_ = groups.collapse_to_first(scored, request.collapse, order).select("external_id", "score", "collapse_key")
        else:
            groups_ = groups.collapse_to_values(scored, request.collapse)
        offset = (request.cursor or {}).get("offset", request.offset)
        page = groups_.orderBy(F.col("score").desc_nulls_last(), "external_id")
        if not unlimited:
            page = page.offset(offset).limit(request.limit) if offset else page.limit(request.limit)
        return Found(request, page, matched, self.schema, groups_)

    def search_all(self, body: Mapping | Request) -> DataFrame:
        """Every hit (external_id, score), in the order of the request's sort if it has one; for sinks, not for collect."""
        return self.search(body, unlimited=True).hits

    def search_many(self, bodies: Sequence[Mapping]) -> list[Found | QueryError]:
        """Independent requests in order; one that fails does not stop the others."""
        if len(bodies) > MAX_SEARCHES:
            raise QueryError("bulk_limit", f"at most {MAX_SEARCHES} searches")
        out: list[Found | QueryError] = []
        for b in bodies:
            try:
                out.append(self.search(b))
            except QueryError as e:
                out.append(e)
        return out

    def nearest(self, field: str, queries: dict[str, Sequence[float]], k: int) -> DataFrame:
        """(query_id, external_id, score, rank) for many vectors in one scan."""
        spec = self.schema.need(field, "nearest")
        checked = {q: nearest.check(v, spec.dim) for q, v in queries.items()}
        return nearest.batch_top_k(self.rows, field, checked, spec.metric, k, self.digits)

    def duplicates(self, field: str, min_group_size: int = 2, limit: int = 100, offset: int = 0):
        """(groups on the page, all groups): see operators.groups.duplicates."""
        return groups.duplicates(self.rows, self.schema, field, min_group_size, limit, offset)

    def duplicate_members(self, field: str, min_group_size: int = 2) -> DataFrame:
        return groups.duplicate_members(self.rows, self.schema, field, min_group_size)

    def stats(self) -> DataFrame:
        return groups.statistics(self.rows, self.schema)

    def audit(self, expected: dict[str, int]) -> DataFrame:
        return groups.coverage_audit(self.rows, self.schema, expected)

    def value(self, external_id: str, field: str) -> DataFrame:
        """One field of one document."""
        self.schema[field]
        return self.rows.where(F.col("external_id") == external_id).select(field)

    def hydrate(self, hits: DataFrame, source: DataFrame, key: str = "external_id") -> DataFrame:
        """The best MAX_LIMIT hits, a page's bound, beside their source rows, in hit order; `found` is false where the
        source has none. For all hits of a search, join them with the source: they have no order to keep."""
        from pyspark.sql import Window

        order = [F.col("score").desc_nulls_last(), "external_id"]
        ranked = hits.orderBy(*order).limit(MAX_LIMIT).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        side = source.withColumn("found", F.lit(True))
        out = ranked.join(side, ranked["external_id"] == side[key], "left")
        out = out.drop(side[key]) if key == "external_id" else out
        return out.withColumn("found", F.coalesce("found", F.lit(False)))

    def tokens(self, field: str) -> DataFrame:
        """(external_id, tokens): a text field as its analyzer reads it."""
        spec = self.schema.need(field, "match")
        return self.rows.where(F.col(field).isNotNull()).select("external_id", analyze(F.col(field), spec.analyzer).alias("tokens"))
