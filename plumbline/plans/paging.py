"""Order, pages, cursors and totals of scored hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CollectionSchema
from .compiler import SCORE
from .request import Request, SortKey, encode_cursor


def _missing_rank(key: SortKey) -> Column:
    """0 for missing values that come first, 1 for values, 2 for missing values that come last."""
    return F.when(F.col(key.field).isNotNull(), F.lit(1)).otherwise(F.lit(0 if key.missing == "first" else 2))


def order_of(keys: tuple[SortKey, ...]) -> list[Column]:
    """The total order: the keys, then external_id; without keys, best score first."""
    if not keys:
        return [F.col(SCORE).desc_nulls_last(), F.asc("external_id")]
    out = []
    for k in keys:
        c, first = F.col(k.field), k.missing == "first"
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if k.descending else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return [*out, F.asc("external_id")]


def select_for_sort(hits: DataFrame, keys: tuple[SortKey, ...]) -> DataFrame:
    for k in keys:
        if k.missing == "exclude":
            hits = hits.where(F.col(k.field).isNotNull())
    return hits


def sort_score(keys: tuple[SortKey, ...], schema: CollectionSchema) -> Column:
    """What a sorted hit reports: its first value that is there, 1 for one that is no number, 0 if none is there."""
    values = [(F.col(k.field).cast("double") if schema[k.field].stored in ("number", "int64", "decimal") else F.when(F.col(k.field).isNotNull(), F.lit(1.0))) for k in keys]
    return F.coalesce(*values, F.lit(0.0))


def after(keys: tuple[SortKey, ...], cursor: dict, schema: CollectionSchema) -> Column:
    """The rows strictly behind a cursor's place."""
    behind = F.col("external_id") > F.lit(cursor["id"])
    if not keys:
        s = cursor.get("score")
        if s is None:
            return behind
        return (F.col(SCORE) < F.lit(float(s))) | ((F.col(SCORE) == F.lit(float(s))) & behind)
    for k, v in list(zip(keys, cursor["values"]))[::-1]:
        rank, c = _missing_rank(k), F.col(k.field)
        if v is None:
            at = 0 if k.missing == "first" else 2
            behind = (rank > at) | ((rank == at) & behind)
        else:
            v = F.lit(v).cast(schema[k.field].spark_type)
            further = F.coalesce((c < v) if k.descending else (c > v), F.lit(False))
            behind = (rank > 1) | ((rank == 1) & (further | (F.coalesce(c == v, F.lit(False)) & behind)))
    return behind


def cursor_of(row, request: Request) -> str:
    """The cursor behind a page whose last hit is `row`."""
    if request.collapse:
        return encode_cursor(offset=(request.cursor or {}).get("offset", request.offset) + request.limit)
    if not request.sort:
        return encode_cursor(score=row["score"], id=row["external_id"])
    plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else str(v)
    return encode_cursor(values=[plain(row[f"sort_{i}"]) for i in range(len(request.sort))], id=row["external_id"])


def total(hits: DataFrame, track: str | int) -> tuple[int, str] | None:
    """(number, 'eq' or 'gte'); beyond an `up_to` bound counting stops, and None where totals are off."""
    if track == "none":
        return None
    if track == "exact":
        return hits.count(), "eq"
    n = hits.select("external_id").limit(track + 1).count()
    return (n, "eq") if n <= track else (track, "gte")
