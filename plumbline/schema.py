"""Declared fields of a collection: kinds, what each kind can do, and the Spark type that holds it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from .errors import QueryError

#: What each kind of field can be asked for.
CAN: dict[str, frozenset[str]] = {
    "text": frozenset({"match"}),
    "keyword": frozenset({"exact", "prefix", "range", "sort", "exists", "duplicates", "collapse", "facet"}),
    "set": frozenset({"exact", "exists", "duplicates", "facet"}),
    "number": frozenset({"exact", "range", "sort", "exists", "duplicates", "metric", "range_facet"}),
    "int64": frozenset({"exact", "range", "sort", "exists", "duplicates", "collapse", "facet", "metric", "range_facet"}),
    "decimal": frozenset({"exact", "range", "sort", "exists", "duplicates", "metric", "range_facet"}),
    "boolean": frozenset({"exact", "exists", "facet"}),
    "date": frozenset({"exact", "range", "sort", "exists", "duplicates", "collapse", "facet", "range_facet"}),
    "timestamp": frozenset({"exact", "range", "sort", "exists", "duplicates"}),
    "vector": frozenset({"nearest"}),
    "hash": frozenset({"hamming"}),
}
ALIASES = {"float64": "number"}
ANALYZERS = ("whitespace_lower", "ngram", "jieba")
METRICS = ("cosine", "dot", "l2")
BACKENDS = ("hnsw-cpu", "flat-cpu")


@dataclass(frozen=True)
class FieldSpec:
    """One declared field. Only text has an analyzer; only vector has dim, metric, backend and quantize."""

    kind: str
    analyzer: str | None = None
    dim: int | None = None
    metric: str | None = None
    backend: str | None = None
    quantize: str | None = None
    multi: bool = False
    facetable: bool = False
    precision: int = 38
    scale: int = 0

    @staticmethod
    def of(spec: FieldSpec | str | Mapping) -> FieldSpec:
        if isinstance(spec, FieldSpec):
            made = spec
        elif isinstance(spec, str):
            made = FieldSpec(spec)
        else:
            given = dict(spec)
            given["kind"] = given.pop("type", given.get("kind"))
            unknown = set(given) - set(FieldSpec.__dataclass_fields__)
            if unknown:
                raise QueryError("bad_request", f"unknown field options: {', '.join(sorted(unknown))}")
            made = FieldSpec(**given)
        return made.normalized()

    def normalized(self) -> FieldSpec:
        s = replace(self, kind=ALIASES.get(self.kind, self.kind))
        if s.kind not in CAN:
            raise QueryError("bad_request", f"unknown field type {self.kind!r}")
        if s.kind == "text":
            s = replace(s, analyzer=s.analyzer or ANALYZERS[0])
            if s.analyzer not in ANALYZERS:
                raise QueryError("bad_request", f"unknown analyzer {s.analyzer!r}")
        elif s.analyzer:
            raise QueryError("bad_request", "only text fields have an analyzer")
        if s.kind == "vector":
            s = replace(s, metric=s.metric or METRICS[0], backend=s.backend or BACKENDS[0])
            if not s.dim or s.dim < 1:
                raise QueryError("bad_request", "a vector field needs a dim of 1 or more")
            if s.metric not in METRICS or s.backend not in BACKENDS:
                raise QueryError("bad_request", f"unknown metric or backend: {s.metric}, {s.backend}")
            if s.quantize not in (None, "sq"):
                raise QueryError("bad_request", f"quantize {s.quantize!r} is not supported")
        elif s.dim or s.metric or s.backend or s.quantize:
            raise QueryError("bad_request", "dim, metric, backend and quantize belong to vector fields")
        if s.multi and s.kind not in ("keyword", "set"):
            raise QueryError("bad_request", "only keyword fields can be multi")
        return s

    @property
    def stored(self) -> str:
        """The kind that decides behaviour: a keyword with several values is a set."""
        return "set" if self.kind == "keyword" and self.multi else self.kind

    def can(self, what: str) -> bool:
        return what in CAN[self.stored]

    @property
    def spark_type(self) -> T.DataType:
        return {
            "set": T.ArrayType(T.StringType()),
            "number": T.DoubleType(),
            "int64": T.LongType(),
            "decimal": T.DecimalType(self.precision, self.scale),
            "boolean": T.BooleanType(),
            "date": T.DateType(),
            "timestamp": T.TimestampType(),
            "vector": T.ArrayType(T.FloatType()),
        }.get(self.stored, T.StringType())


@dataclass(frozen=True)
class CollectionSchema:
    """Fields by name, and a version that grows with every change of the declaration."""

    fields: dict[str, FieldSpec] = field(default_factory=dict)
    version: int = 1

    @staticmethod
    def of(fields: Mapping) -> CollectionSchema:
        for name in fields:
            _check_name(name)
        return CollectionSchema({n: FieldSpec.of(s) for n, s in fields.items()})

    def __getitem__(self, name: str) -> FieldSpec:
        if name not in self.fields:
            raise QueryError("unknown_field", f"no field {name!r}")
        return self.fields[name]

    def need(self, name: str, what: str) -> FieldSpec:
        """The field, which must be able to do `what`."""
        spec = self[name]
        if not spec.can(what):
            raise QueryError("type_mismatch", f"field {name!r} of type {spec.stored} does not support {what}")
        return spec

    def merged(self, fields: Mapping, occupied: frozenset[str] | set[str] = frozenset()) -> CollectionSchema:
        """With further fields. The same declaration again changes nothing; another one for a known field is refused,
        but that `facetable` may be switched on while no document holds the field (`occupied` names those that do)."""
        out, changed = dict(self.fields), False
        for name, spec in fields.items():
            _check_name(name)
            new, old = FieldSpec.of(spec), out.get(name)
            if new == old:
                continue
            if old is not None:
                if replace(old, facetable=True) != new:
                    raise QueryError("bad_request", f"field {name!r} is declared otherwise")
                if name in occupied:
                    raise QueryError("shadow_rebuild_required", f"field {name!r} holds documents already")
            out[name], changed = new, True
        return CollectionSchema(out, self.version + 1) if changed else self

    def without(self, name: str) -> CollectionSchema:
        self[name]
        return CollectionSchema({n: s for n, s in self.fields.items() if n != name}, self.version + 1)

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField("external_id", T.StringType(), False), *[T.StructField(n, s.spark_type) for n, s in self.fields.items()]])

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "fields": {n: asdict(s) for n, s in self.fields.items()}})

    @staticmethod
    def from_json(text: str) -> CollectionSchema:
        d = json.loads(text)
        return CollectionSchema({n: FieldSpec(**s) for n, s in d["fields"].items()}, d["version"])


def _check_name(name: str) -> None:
    if not name or name.startswith("__") or name == "external_id":
        raise QueryError("bad_request", f"a field cannot be named {name!r}")
