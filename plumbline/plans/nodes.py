"""The nodes of a query tree, their JSON form, and the limits on a tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from ..errors import QueryError

# Limits of a request.
MAX_DEPTH, MAX_NODES, MAX_TERMS, MAX_K = 32, 1024, 1024, 10_000
RRF_K = 60


class Node:
    """A node of a query tree. `children` are what it combines."""

    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Term(Node):
    field: str
    value: Any


@dataclass(frozen=True)
class Terms(Node):
    field: str
    values: tuple


@dataclass(frozen=True)
class Prefix(Node):
    field: str
    value: str


@dataclass(frozen=True)
class Ids(Node):
    values: tuple[str, ...]


@dataclass(frozen=True)
class Exists(Node):
    field: str


@dataclass(frozen=True)
class Range(Node):
    field: str
    gt: Any = None
    gte: Any = None
    lt: Any = None
    lte: Any = None


@dataclass(frozen=True)
class Duplicated(Node):
    field: str
    min_group_size: int = 2


@dataclass(frozen=True)
class Match(Node):
    field: str
    text: str
    op: str = "and"


@dataclass(frozen=True)
class Phrase(Node):
    """All tokens of the text, one after the other; scored as the match of all of them."""

    field: str
    text: str


@dataclass(frozen=True)
class Fuzzy(Node):
    """A token within so many single-character edits of the term; every such token counts as the term itself."""

    field: str
    value: str
    max_edits: int = 1


@dataclass(frozen=True)
class Knn(Node):
    field: str
    vector: tuple[float, ...]
    k: int


@dataclass(frozen=True)
class Hamming(Node):
    field: str
    hash: str
    max_distance: int


@dataclass(frozen=True)
class HasChild(Node):
    collection: str
    field: str
    query: Node


@dataclass(frozen=True)
class Rrf(Node):
    queries: tuple[Node, ...]
    k: int = RRF_K

    @property
    def children(self):
        return self.queries


@dataclass(frozen=True)
class And(Node):
    clauses: tuple[Node, ...]

    @property
    def children(self):
        return self.clauses


@dataclass(frozen=True)
class Or(Node):
    clauses: tuple[Node, ...]

    @property
    def children(self):
        return self.clauses


@dataclass(frozen=True)
class Not(Node):
    clause: Node

    @property
    def children(self):
        return (self.clause,)


@dataclass(frozen=True)
class Bool(Node):
    """must: all; should: `minimum_should_match` of them at least (1 without must, else 0); must_not: none."""

    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    minimum_should_match: int | None = None

    @property
    def children(self):
        return (*self.must, *self.should, *self.must_not)

    @property
    def least(self) -> int:
        return (0 if self.must else 1) if self.minimum_should_match is None else self.minimum_should_match


def _fail(message: str) -> QueryError:
    return QueryError("bad_request", message)


def _options(name: str, body: Any, need: tuple[str, ...], may: tuple[str, ...] = ()) -> dict:
    if not isinstance(body, dict):
        raise _fail(f"{name} takes an object")
    if unknown := set(body) - {*need, *may}:
        raise _fail(f"{name} does not know {', '.join(sorted(unknown))}")
    if missing := [k for k in need if k not in body]:
        raise _fail(f"{name} needs {', '.join(missing)}")
    return body


def _whole(name: str, value: Any, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise _fail(f"{name} must be a whole number of {least} or more")
    return value


def _list(name: str, value: Any) -> list:
    if not isinstance(value, (list, tuple)):
        raise _fail(f"{name} takes a list")
    return list(value)


def _text(name: str, value: Any) -> str:
    if not isinstance(value, str):
        raise _fail(f"{name} must be a string")
    return value


def parse(tree: Any, depth: int = 1) -> Node:
    """A node from its JSON form: an object with the node's name as its only key."""
    if isinstance(tree, Node):
        return tree
    if depth > MAX_DEPTH:
        raise QueryError("query_too_complex", f"the tree is deeper than {MAX_DEPTH}")
    if not isinstance(tree, dict) or len(tree) != 1:
        raise _fail("a query node is an object with one key")
    ((name, body),) = tree.items()
    sub = lambda x: parse(x, depth + 1)
    many = lambda what, xs: tuple(sub(x) for x in _list(what, xs))
    if name == "term":
        o = _options(name, body, ("field", "value"))
        return Term(_text("field", o["field"]), o["value"])
    if name == "terms":
        o = _options(name, body, ("field", "values"))
        return Terms(_text("field", o["field"]), tuple(_list("values", o["values"])))
    if name == "prefix":
        o = _options(name, body, ("field", "value"))
        return Prefix(_text("field", o["field"]), _text("value", o["value"]))
    if name == "ids":
        return Ids(tuple(_text("an id", v) for v in _list("values", _options(name, body, ("values",))["values"])))
    if name == "exists":
        return Exists(_text("field", _options(name, body, ("field",))["field"]))
    if name == "range":
        o = _options(name, body, ("field",), ("gt", "gte", "lt", "lte"))
        return Range(**{**o, "field": _text("field", o["field"])})
    if name == "duplicated":
        o = _options(name, body, ("field",), ("min_group_size",))
        return Duplicated(_text("field", o["field"]), _whole("min_group_size", o.get("min_group_size", 2)))
    if name in ("match", "phrase"):
        o = _options(name, body, ("field", "text"), ("op",) if name == "match" else ())
        if o.get("op", "and") not in ("and", "or"):
            raise _fail("op is 'and' or 'or'")
        args = (_text("field", o["field"]), _text("text", o["text"]))
        return Match(*args, o.get("op", "and")) if name == "match" else Phrase(*args)
    if name == "fuzzy":
        o = _options(name, body, ("field", "value"), ("max_edits",))
        return Fuzzy(_text("field", o["field"]), _text("value", o["value"]), _whole("max_edits", o.get("max_edits", 1)))
    if name == "knn":
        o = _options(name, body, ("field", "vector", "k"))
        return Knn(_text("field", o["field"]), tuple(_list("vector", o["vector"])), _whole("k", o["k"]))
    if name == "hamming":
        o = _options(name, body, ("field", "hash", "max_distance"))
        return Hamming(_text("field", o["field"]), _text("hash", o["hash"]), _whole("max_distance", o["max_distance"]))
    if name == "has_child":
        o = _options(name, body, ("collection", "field", "query"))
        return HasChild(_text("collection", o["collection"]), _text("field", o["field"]), sub(o["query"]))
    if name == "rrf":
        o = _options(name, body, ("queries",), ("k",))
        return Rrf(many("queries", o["queries"]), _whole("k", o.get("k", RRF_K)))
    if name in ("and", "or"):
        return (And if name == "and" else Or)(many(name, body))
    if name == "not":
        return Not(sub(body))
    if name == "bool":
        o = _options(name, body, (), ("must", "should", "must_not", "minimum_should_match"))
        m = o.get("minimum_should_match")
        return Bool(*(many(k, o.get(k, [])) for k in ("must", "should", "must_not")), None if m is None else _whole("minimum_should_match", m))
    raise _fail(f"unknown query node {name!r}")


def to_json(node: Node) -> dict:
    """The JSON form of a node; parse(to_json(x)) == x."""
    if isinstance(node, Term):
        return {"term": {"field": node.field, "value": node.value}}
    if isinstance(node, Terms):
        return {"terms": {"field": node.field, "values": list(node.values)}}
    if isinstance(node, Prefix):
        return {"prefix": {"field": node.field, "value": node.value}}
    if isinstance(node, Ids):
        return {"ids": {"values": list(node.values)}}
    if isinstance(node, Exists):
        return {"exists": {"field": node.field}}
    if isinstance(node, Range):
        ends = {k: getattr(node, k) for k in ("gt", "gte", "lt", "lte") if getattr(node, k) is not None}
        return {"range": {"field": node.field, **ends}}
    if isinstance(node, Duplicated):
        return {"duplicated": {"field": node.field, "min_group_size": node.min_group_size}}
    if isinstance(node, Match):
        return {"match": {"field": node.field, "text": node.text, "op": node.op}}
    if isinstance(node, Phrase):
        return {"phrase": {"field": node.field, "text": node.text}}
    if isinstance(node, Fuzzy):
        return {"fuzzy": {"field": node.field, "value": node.value, "max_edits": node.max_edits}}
    if isinstance(node, Knn):
        return {"knn": {"field": node.field, "vector": list(node.vector), "k": node.k}}
    if isinstance(node, Hamming):
        return {"hamming": {"field": node.field, "hash": node.hash, "max_distance": node.max_distance}}
    if isinstance(node, HasChild):
        return {"has_child": {"collection": node.collection, "field": node.field, "query": to_json(node.query)}}
    if isinstance(node, Rrf):
        return {"rrf": {"queries": [to_json(q) for q in node.queries], "k": node.k}}
    if isinstance(node, Not):
        return {"not": to_json(node.clause)}
    if isinstance(node, Bool):
        out: dict = {k: [to_json(c) for c in getattr(node, k)] for k in ("must", "should", "must_not") if getattr(node, k)}
        return {"bool": out if node.minimum_should_match is None else {**out, "minimum_should_match": node.minimum_should_match}}
    return {"and" if isinstance(node, And) else "or": [to_json(c) for c in node.children]}


def walk(root: Node) -> Iterator[tuple[Node, int]]:
    """Every node with its depth, child queries included."""
    todo = [(root, 1)]
    while todo:
        node, depth = todo.pop()
        yield node, depth
        below = (node.query,) if isinstance(node, HasChild) else node.children
        todo += [(c, depth + 1) for c in below]


def check_limits(root: Node) -> None:
    """Raises query_too_complex for a tree beyond the limits."""
    for n, (node, depth) in enumerate(walk(root), 1):
        if depth > MAX_DEPTH or n > MAX_NODES:
            raise QueryError("query_too_complex", f"at most {MAX_NODES} nodes, {MAX_DEPTH} deep")
        if isinstance(node, Terms) and len(node.values) > MAX_TERMS:
            raise QueryError("query_too_complex", f"terms takes at most {MAX_TERMS} values")
        if isinstance(node, Knn) and node.k > MAX_K:
            raise QueryError("query_too_complex", f"k is at most {MAX_K}")
        if isinstance(node, Prefix) and not node.value:
            raise _fail("a prefix cannot be empty")
