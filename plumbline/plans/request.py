"""Search requests: the query with paging, sorting, collapse, totals, facets and metrics."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import QueryError
from ..schema import CollectionSchema
from . import nodes

# Limits of a page.
DEFAULT_LIMIT, MAX_LIMIT, MAX_OFFSET, MAX_SORT_KEYS, UP_TO = 20, 1000, 10_000, 4, 10_000
MAX_SEARCHES = 32
ALIAS = re.compile(r"[A-Za-z][A-Za-z0-9_.-]{0,63}")


@dataclass(frozen=True)
class SortKey:
    """Rows without the value go (`exclude`), or come before or after all others whatever the direction."""

    field: str
    descending: bool = False
    missing: str = "exclude"


@dataclass(frozen=True)
class Request:
    """`query` both selects and scores. `scoring` scores and selects, `filter` only selects: the split form."""

    query: nodes.Node | None = None
    scoring: nodes.Node | None = None
    filter: nodes.Node | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    cursor: dict | None = None
    sort: tuple[SortKey, ...] = ()
    collapse: str | None = None
    keep_ids: bool = False
    track_total: str | int = UP_TO
    routing_key: str | None = None
    facets: dict[str, dict] = field(default_factory=dict)
    metrics: dict[str, dict] = field(default_factory=dict)

    @property
    def split(self) -> bool:
        return self.query is None

    def trees(self) -> list[nodes.Node]:
        return [t for t in (self.query, self.scoring, self.filter) if t is not None]


def encode_cursor(**values) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def decode_cursor(text: str) -> dict | None:
    """The cursor's values; None (the first page) for what is not a cursor."""
    try:
        d = json.loads(base64.urlsafe_b64decode(text.encode()))
    except (ValueError, UnicodeError):
        return None
    ok = isinstance(d, dict) and (isinstance(d.get("offset"), int) or "id" in d)
    return d if ok else None


def _total(value: Any) -> str | int:
    if isinstance(value, bool):
        return "exact" if value else "none"
    if value in ("none", "exact"):
        return value
    n = value.get("up_to") if isinstance(value, Mapping) and set(value) == {"up_to"} else None
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise QueryError("bad_request", "track_total is 'none', 'exact', a boolean or {'up_to': n}")
    return n


def _sort(keys: Any) -> tuple[SortKey, ...]:
    if not isinstance(keys, (list, tuple)) or not 1 <= len(keys) <= MAX_SORT_KEYS:
        raise QueryError("unsupported_sort", f"sort takes 1 to {MAX_SORT_KEYS} keys")
    out = []
    for k in keys:
        if not isinstance(k, Mapping) or set(k) - {"field", "order", "missing"} or "field" not in k:
            raise QueryError("bad_request", "a sort key has a field, and may have order and missing")
        if k.get("order", "asc") not in ("asc", "desc") or k.get("missing", "exclude") not in ("exclude", "first", "last"):
            raise QueryError("bad_request", "order is asc or desc; missing is exclude, first or last")
        out.append(SortKey(k["field"], k.get("order") == "desc", k.get("missing", "exclude")))
    return tuple(out)


def parse(body: Mapping | Request, unlimited: bool = False) -> Request:
    """A request from its JSON form; unknown keys are refused. `unlimited` lifts the bounds of a page."""
    if isinstance(body, Request):
        return body
    if unknown := set(body) - set(Request.__dataclass_fields__):
        raise QueryError("bad_request", f"unknown request keys: {', '.join(sorted(unknown))}")
    limit, offset = body.get("limit", DEFAULT_LIMIT), body.get("offset", 0)
    for n, v, most in (("limit", limit, MAX_LIMIT), ("offset", offset, MAX_OFFSET)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 0 or (v > most and not unlimited):
            raise QueryError("invalid_pagination", f"{n} is a whole number from 0 to {most}")
    if body.get("cursor") is not None and offset:
        raise QueryError("invalid_pagination", "offset and cursor exclude each other")
    if "query" in body and ("scoring" in body or "filter" in body):
        raise QueryError("bad_request", "query is the one-tree form; scoring and filter are the split form")
    collapse = body.get("collapse")
    keep_ids = isinstance(collapse, Mapping)
    if keep_ids and set(collapse) != {"field"}:
        raise QueryError("bad_request", "collapse takes a field")
    trees = {k: nodes.parse(body[k]) for k in ("query", "scoring", "filter") if body.get(k) is not None}
    for t in trees.values():
        nodes.check_limits(t)
    for kind in ("facets", "metrics"):
        for name in body.get(kind, {}):
            if not ALIAS.fullmatch(name):
                raise QueryError("bad_request", f"{kind} cannot be named {name!r}")
    return Request(
        **trees,
        limit=limit,
        offset=offset,
        cursor=decode_cursor(body["cursor"]) if body.get("cursor") is not None else None,
        sort=_sort(body["sort"]) if body.get("sort") is not None else (),
        collapse=collapse["field"] if keep_ids else collapse,
        keep_ids=keep_ids,
        track_total=_total(body.get("track_total", {"up_to": UP_TO})),
        routing_key=body.get("routing_key"),
        facets=dict(body.get("facets", {})),
        metrics=dict(body.get("metrics", {})),
    )


def check_sort(request: Request, schema: CollectionSchema) -> None:
    """Sorting by fields excludes collapse and queries that rank by nearness."""
    if not request.sort:
        return
    if request.collapse and not request.keep_ids:
        raise QueryError("unsupported_sort", "sort and collapse exclude each other")
    ranked = (nodes.Knn, nodes.Rrf, nodes.Hamming)

    def ranks(node: nodes.Node) -> bool:
        return isinstance(node, ranked) or any(ranks(c) for c in node.children)

    if any(ranks(t) for t in request.trees()) and not request.split:
        raise QueryError("unsupported_sort", "sort excludes knn, rrf and hamming")
    for key in request.sort:
        if not schema[key.field].can("sort"):
            raise QueryError("unsupported_sort", f"field {key.field!r} cannot be sorted by")


_SCORING = (nodes.Match, nodes.Phrase, nodes.Fuzzy, nodes.Knn, nodes.Rrf, nodes.Hamming, nodes.Bool)


def split_tree(tree: nodes.Node) -> tuple[nodes.Node | None, nodes.Node | None]:
    """(scoring, filter) of a one-tree query; refused where the split would change what is found or its score."""
    kinds = {isinstance(n, _SCORING) for n in _leaves(tree)}
    if kinds <= {True}:
        return tree, None
    if kinds == {False}:
        return None, tree
    if not isinstance(tree, nodes.And):
        raise QueryError("bad_request", "only an and over both kinds of nodes can be split")
    parts = [split_tree(c) for c in tree.clauses]
    both = []
    for side in zip(*parts):
        have = tuple(x for x in side if x is not None)
        both.append(None if not have else have[0] if len(have) == 1 else nodes.And(have))
    return both[0], both[1]


def _leaves(node: nodes.Node) -> list[nodes.Node]:
    if isinstance(node, _SCORING) or not node.children:
        return [node]
    return [x for c in node.children for x in _leaves(c)]


def migrate(body: Mapping) -> dict:
    """The split form of a one-tree request, as JSON."""
    out = {k: v for k, v in body.items() if k not in ("query", "track_total", "collapse")}
    if body.get("cursor") is not None:
        raise QueryError("bad_request", "a cursor does not carry over; start from the first page")
    for key in body.get("sort") or ():
        if key.get("missing", "exclude") == "exclude":
            raise QueryError("bad_request", "choose first or last for missing sort values")
    if body.get("query") is not None:
        for name, tree in zip(("scoring", "filter"), split_tree(nodes.parse(body["query"]))):
            if tree is not None:
                out[name] = nodes.to_json(tree)
    if "track_total" in body:
        t = body["track_total"]
        out["track_total"] = ("exact" if t else "none") if isinstance(t, bool) else t
    if body.get("collapse") is not None:
        out["collapse"] = {"field": body["collapse"]} if isinstance(body["collapse"], str) else body["collapse"]
    return out
