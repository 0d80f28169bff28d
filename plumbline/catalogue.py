"""The query catalogue: every operator applied to the bundled tables, each with DuckDB SQL that must agree.

Tables become collections (see `open_catalog`). Scores are rounded to six digits before hits are ordered, here and in
the SQL, because two engines may add the same numbers in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .collection import Collection
from .functions import text as analyzers
from .functions import values, vectors
from .operators import facets as facet_ops
from .plans import request
from .plans.nodes import Match
from .sources import json_lines, postings, snapshot
from .storage import new_path
from .streaming import fold, rebuild, stream

DIGITS = 6
VECTORS = {name: [round(((i * 37 + s * 11) % 17 - 8) / 8.0, 4) for i in range(64)] for s, name in enumerate(("a", "b", "c"))}
HASH = "0x5a5a0f0f3c3c9696"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FIELDS: dict[str, dict] = {
    "docs": {
        "text": "text", "lang": {"type": "keyword", "facetable": True}, "source": {"type": "keyword", "facetable": True}, "n_chars": "number",
        "size": "int64", "tags": "set", "part": "keyword", "rare": "number", "print": "hash",
    },
    "orders": {"status": "keyword", "priority": "keyword", "total": "number", "cust": "keyword", "day": {"type": "date"}, "price": {"type": "decimal", "precision": 18, "scale": 2}},
    "items": {"order": "keyword", "flag": "keyword", "line_status": "keyword", "quantity": "number", "price": "number", "discount": "number"},
    "customers": {"name": "keyword", "segment": "keyword", "balance": "number", "nation": "int64"},
    "parts": {"name": {"type": "text", "analyzer": "ngram"}, "brand": "keyword", "kind": "keyword", "size": "number"},
    "vectors": {"embedding": {"type": "vector", "dim": 64, "metric": "cosine"}, "label": "int64"},
    "vectors_dot": {"embedding": {"type": "vector", "dim": 64, "metric": "dot"}, "label": "int64"},
    "vectors_l2": {"embedding": {"type": "vector", "dim": 64, "metric": "l2"}, "label": "int64"},
    "vectors_sq": {"embedding": {"type": "vector", "dim": 64, "metric": "cosine", "quantize": "sq"}, "label": "int64"},
}


def _docs(t: DataFrame) -> DataFrame:
    odd = lambda n: F.col("n_chars") % n == 0
    return t.select(
        F.col("doc_id").cast("string").alias("external_id"), "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.col("n_chars").alias("size"), F.array_distinct(F.array("lang", "source")).alias("tags"),
        F.when(odd(4), F.col("source")).alias("part"), F.when(odd(3), (F.col("n_chars") % 50).cast("double")).alias("rare"),
        F.substring(F.md5("text"), 1, 16).alias("print"),
    )


def _vectors(t: DataFrame) -> DataFrame:
    return t.select(F.col("vec_id").cast("string").alias("external_id"), "embedding", F.col("label").cast("long").alias("label"))


_ROWS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "docs": ("documents", _docs),
    "orders": ("orders", lambda t: t.select(
        F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("string").alias("cust"), F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"))),
    "items": ("lineitem", lambda t: t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"), F.col("l_orderkey").cast("string").alias("order"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))),
    "customers": ("customer", lambda t: t.select(
        F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("long").alias("nation"))),
    "parts": ("part", lambda t: t.select(
        F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
        F.col("p_size").cast("double").alias("size"))),
    **{n: ("embeddings", _vectors) for n in ("vectors", "vectors_dot", "vectors_l2", "vectors_sq")},
}


def open_catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """The named collections over the tables; reading is lazy and prunes columns."""
    catalog = Catalog(spark, digits=DIGITS)
    for n in names or _FIELDS:
        source, make = _ROWS[n]
        catalog.declare(n, _FIELDS[n], make(table(spark, sf_dir, source)))
    return catalog


#: Collections with an index of their texts, which later queries of the session find again.
_indexed: dict[tuple, Collection] = {}


def _open(spark: SparkSession, sf_dir: str, name: str, *more: str) -> Collection:
    if name not in ("docs", "parts"):
        return open_catalog(spark, sf_dir, name, *more)[name]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexed:
        _indexed[key] = open_catalog(spark, sf_dir, name)[name].indexed()
    held = _indexed[key]
    return Collection(held.rows, held.schema, open_catalog(spark, sf_dir, name, *more) if more else held.catalog, held.digits, held.indexes)


def _page(name: str, body: dict, *more: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _open(spark, sf_dir, name, *more).search(body).hits.select("external_id", "score")

    return run


def _all(name: str, query: dict, *more: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _open(spark, sf_dir, name, *more).search_all({"query": query}).select("external_id", "score")

    return run


# SQL that stands for the collections and for recurring pieces.

_WORDS = r"list_filter(list_transform(string_split_regex(trim(lower({c})), '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda x: x <> '')"
_SQUEEZED = r"regexp_replace(lower({c}), '\s+', '', 'g')"
_GRAMS = (
    "list_concat(list_transform(range(1, greatest(length({s}), 1)), lambda i: substr({s}, i::BIGINT, 2)), "
    "list_transform(range(1, greatest(length({s}) - 1, 1)), lambda i: substr({s}, i::BIGINT, 3)))"
)
DOCS = (
    "docs AS (SELECT doc_id::VARCHAR AS external_id, text, lang, source, n_chars::DOUBLE AS n_chars, n_chars AS size, list_distinct([lang, source]) AS tags, "
    "CASE WHEN n_chars % 4 = 0 THEN source END AS part, CASE WHEN n_chars % 3 = 0 THEN (n_chars % 50)::DOUBLE END AS rare, md5(text) AS print FROM documents)"
)
ORDERS = (
    "os AS (SELECT o_orderkey::VARCHAR AS external_id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total, o_custkey::VARCHAR AS cust, "
    "o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS price FROM orders)"
)
CUSTOMERS = "cs AS (SELECT c_custkey::VARCHAR AS external_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey::BIGINT AS nation FROM customer)"
_TOP = "ORDER BY score DESC, external_id LIMIT {n}"


def _bm25(source: str, column: str, tokens: list[str], op: str = "or", ngram: bool = False, name: str = "m") -> str:
    """CTEs up to `<name>` (external_id, score rounded) for the hits of a match."""
    toks = _GRAMS.format(s=_SQUEEZED.format(c=column)) if ngram else _WORDS.format(c=column)
    need = len(set(tokens)) if op == "and" else 1
    q = ", ".join(f"('{t}', {tokens.count(t)})" for t in dict.fromkeys(tokens))
    return f"""{name}_t AS (SELECT external_id, {toks} AS toks FROM {source} WHERE {column} IS NOT NULL),
{name}_s AS (SELECT count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE AS total FROM {name}_t),
{name}_f AS (SELECT external_id, len(toks)::DOUBLE AS dl, q.tok, q.w, len(list_filter(toks, lambda x: x = q.tok))::DOUBLE AS tf FROM {name}_t, (VALUES {q}) AS q(tok, w)),
{name}_d AS (SELECT tok, count(*)::DOUBLE AS df FROM {name}_f WHERE tf > 0 GROUP BY tok),
{name} AS (SELECT external_id, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / total))), 6) AS score
  FROM {name}_f JOIN {name}_d USING (tok), {name}_s WHERE tf > 0 GROUP BY external_id HAVING count(*) >= {need})"""


def _vec(v: list[float]) -> str:
    return "[" + ", ".join(map(str, v)) + "]::DOUBLE[]"


_NEAR = {
    "cosine": "list_cosine_similarity(embedding::DOUBLE[], {q}) - 1",
    "dot": "list_inner_product(embedding::DOUBLE[], {q})",
    "l2": "-list_distance(embedding::DOUBLE[], {q})",
}


def _knn_sql(metric: str, vector: str, k: int, where: str = "TRUE") -> str:
    return f"SELECT vec_id::VARCHAR AS external_id, round({_NEAR[metric].format(q=_vec(VECTORS[vector]))}, 6) AS score FROM embeddings WHERE {where} ORDER BY score DESC, external_id LIMIT {k}"


def _hamming(hex_: str) -> str:
    h = hex_.removeprefix("0x").zfill(16)
    part = lambda a, q: f"bit_count(xor(('0x' || substr(print, {a}, 8))::BIGINT, {int(q, 16)}::BIGINT))"
    return f"({part(1, h[:8])} + {part(9, h[8:])})"


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    Q[name] = run
    if sql is not None:
        SQL[name] = sql.strip()


# Leaves.
_one = "SELECT external_id, 1.0::DOUBLE AS score FROM {t} WHERE {w}"
_add("term_keyword", _all("orders", {"term": {"field": "status", "value": "F"}}), f"WITH {ORDERS} " + _one.format(t="os", w="status = 'F'"))
_add("term_number", _all("items", {"term": {"field": "quantity", "value": 17}}), "SELECT l_orderkey || '-' || l_linenumber AS external_id, 1.0::DOUBLE AS score FROM lineitem WHERE l_quantity = 17")
_add("term_set", _all("docs", {"term": {"field": "tags", "value": "src3"}}), f"WITH {DOCS} " + _one.format(t="docs", w="list_contains(tags, 'src3')"))
_add("terms_keyword", _all("orders", {"terms": {"field": "priority", "values": ["1-URGENT", "2-HIGH", "none"]}}), f"WITH {ORDERS} " + _one.format(t="os", w="priority IN ('1-URGENT', '2-HIGH', 'none')"))
_add("terms_set", _all("docs", {"terms": {"field": "tags", "values": ["fr", "src7"]}}), f"WITH {DOCS} " + _one.format(t="docs", w="list_has_any(tags, ['fr', 'src7'])"))
_add("prefix", _all("customers", {"prefix": {"field": "name", "value": "Customer#0000001"}}), f"WITH {CUSTOMERS} " + _one.format(t="cs", w="starts_with(name, 'Customer#0000001')"))
_add("ids", _all("orders", {"ids": {"values": ["1", "3", "77", "no such"]}}), f"WITH {ORDERS} " + _one.format(t="os", w="external_id IN ('1', '3', '77', 'no such')"))
_add("range_number", _all("orders", {"range": {"field": "total", "gte": 1000, "gt": 5000, "lt": 120000.5}}), f"WITH {ORDERS} " + _one.format(t="os", w="total >= 1000 AND total < 120000.5"))
_add("range_keyword", _all("customers", {"range": {"field": "segment", "gt": "AUTOMOBILE", "lte": "HOUSEHOLD"}}), f"WITH {CUSTOMERS} " + _one.format(t="cs", w="segment > 'AUTOMOBILE' AND segment <= 'HOUSEHOLD'"))
_add("range_date", _all("orders", {"range": {"field": "day", "gte": "1995-01-01", "lt": "1996-06-01"}}), f"WITH {ORDERS} " + _one.format(t="os", w="day >= DATE '1995-01-01' AND day < DATE '1996-06-01'"))
_add("range_decimal", _all("orders", {"range": {"field": "price", "gte": "1000.50", "lt": "50000.25"}}), f"WITH {ORDERS} " + _one.format(t="os", w="price >= 1000.50 AND price < 50000.25"))
_add("range_int64", _all("customers", {"range": {"field": "nation", "gte": 5, "lte": 9}}), f"WITH {CUSTOMERS} " + _one.format(t="cs", w="nation BETWEEN 5 AND 9"))
_add("exists", _all("docs", {"exists": {"field": "rare"}}), f"WITH {DOCS} " + _one.format(t="docs", w="rare IS NOT NULL"))
_add("duplicated_keyword", _all("orders", {"duplicated": {"field": "cust", "min_group_size": 12}}), f"WITH {ORDERS} " + _one.format(t="os", w="cust IN (SELECT cust FROM os GROUP BY cust HAVING count(*) >= 12)"))
_add(
    "duplicated_set", _all("docs", {"duplicated": {"field": "tags", "min_group_size": 60}}),
    f"WITH {DOCS}, e AS (SELECT external_id, unnest(tags) AS v FROM docs), g AS (SELECT v FROM e GROUP BY v HAVING count(*) >= 60) SELECT DISTINCT external_id, 1.0::DOUBLE AS score FROM e JOIN g USING (v)",
)
_add("hamming", _all("docs", {"hamming": {"field": "print", "hash": HASH, "max_distance": 28}}), f"WITH {DOCS} SELECT external_id, (64 - {_hamming(HASH)}) / 64.0::DOUBLE AS score FROM docs WHERE {_hamming(HASH)} <= 28")

# Text.
_add("match_or", _page("docs", {"query": {"match": {"field": "text", "text": "the of", "op": "or"}}, "limit": 100}), f"WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of'])} SELECT * FROM m {_TOP.format(n=100)}")
_add("match_and_all", _all("docs", {"match": {"field": "text", "text": "The, of THE"}}), f"WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of', 'the'], 'and')} SELECT * FROM m")
_add("match_ngram", _page("parts", {"query": {"match": {"field": "name", "text": "mall ri"}}, "limit": 50}), f"WITH ps AS (SELECT p_partkey::VARCHAR AS external_id, p_name AS name FROM part), {_bm25('ps', 'name', ['ma', 'al', 'll', 'lr', 'ri', 'mal', 'all', 'llr', 'lri'], 'and', True)} SELECT * FROM m {_TOP.format(n=50)}")
_add(
    "phrase", _all("docs", {"phrase": {"field": "text", "text": "of the"}}),
    f"WITH {DOCS}, {_bm25('docs', 'text', ['of', 'the'], 'and')} SELECT m.* FROM m JOIN m_t USING (external_id) WHERE len(list_filter(range(1, len(toks)), lambda i: toks[i::BIGINT] = 'of' AND toks[i::BIGINT + 1] = 'the')) > 0",
)
_add(
    "fuzzy", _all("docs", {"fuzzy": {"field": "text", "value": "them", "max_edits": 1}}),
    f"""WITH {DOCS}, t AS (SELECT external_id, {_WORDS.format(c='text')} AS toks FROM docs), s AS (SELECT count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE AS total FROM t),
f AS (SELECT external_id, len(toks)::DOUBLE AS dl, len(list_filter(toks, lambda x: levenshtein(x, 'them') <= 1))::DOUBLE AS tf FROM t),
d AS (SELECT count(*)::DOUBLE AS df FROM f WHERE tf > 0)
SELECT external_id, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / total)), 6) AS score FROM f, d, s WHERE tf > 0""",
)
_add(
    "filtered_match",
    _page("docs", {"query": {"and": [{"match": {"field": "text", "text": "the of", "op": "or"}}, {"term": {"field": "lang", "value": "en"}}, {"range": {"field": "n_chars", "lt": 2000}}]}}),
    f"WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of'])} SELECT external_id, round(m.score + 2, 6) AS score FROM m JOIN docs USING (external_id) WHERE lang = 'en' AND n_chars < 2000 {_TOP.format(n=20)}",
)

# Boolean trees.
_T = {"term": {"field": "status", "value": "F"}}
_R = {"range": {"field": "total", "gt": 150000}}
_U = {"term": {"field": "priority", "value": "1-URGENT"}}
_add("and_scores", _all("orders", {"and": [_T, _R, {"not": _U}]}), f"WITH {ORDERS} SELECT external_id, 3.0::DOUBLE AS score FROM os WHERE status = 'F' AND total > 150000 AND priority <> '1-URGENT'")
_add("or_scores", _all("orders", {"or": [_T, _R, _U]}), f"WITH {ORDERS}, x AS (SELECT external_id, (status = 'F')::INT + (total > 150000)::INT + (priority = '1-URGENT')::INT AS n FROM os) SELECT external_id, n::DOUBLE AS score FROM x WHERE n > 0")
_add("not_alone", _all("orders", {"not": _T}), f"WITH {ORDERS} " + _one.format(t="os", w="status <> 'F'"))
_add("and_only_not", _all("orders", {"and": [{"not": _T}, {"not": _U}]}), f"WITH {ORDERS} SELECT external_id, 3.0::DOUBLE AS score FROM os WHERE status <> 'F' AND priority <> '1-URGENT'")
_add("nested", _all("orders", {"or": [{"and": [_T, {"or": [_R, _U]}]}, {"not": {"or": [_T, _U]}}]}), f"""WITH {ORDERS}, x AS (SELECT external_id, status = 'F' AS t, (total > 150000)::INT AS r, (priority = '1-URGENT')::INT AS u FROM os)
SELECT external_id, (CASE WHEN t AND r + u > 0 THEN 1 + r + u ELSE 0 END + CASE WHEN NOT t AND u = 0 THEN 1 ELSE 0 END)::DOUBLE AS score FROM x WHERE (t AND r + u > 0) OR (NOT t AND u = 0)""")  # fmt: skip
_add("empty_and", _all("orders", {"and": []}), "SELECT ''::VARCHAR AS external_id, 0.0::DOUBLE AS score WHERE FALSE")
_add(
    "bool_should", _all("orders", {"bool": {"should": [_T, _R, _U], "must_not": [{"term": {"field": "status", "value": "P"}}], "minimum_should_match": 2}}),
    f"WITH {ORDERS}, x AS (SELECT external_id, (status = 'F')::INT + (total > 150000)::INT + (priority = '1-URGENT')::INT AS n FROM os WHERE status <> 'P') SELECT external_id, n::DOUBLE AS score FROM x WHERE n >= 2",
)
_add("has_child", _all("orders", {"has_child": {"collection": "items", "field": "order", "query": {"range": {"field": "quantity", "gte": 49}}}}, "items"), f"WITH {ORDERS} " + _one.format(t="os", w="external_id IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_quantity >= 49)"))
_add(
    "not_has_child", _all("orders", {"and": [_T, {"not": {"has_child": {"collection": "items", "field": "order", "query": {"term": {"field": "flag", "value": "R"}}}}}]}, "items"),
    f"WITH {ORDERS} SELECT external_id, 2.0::DOUBLE AS score FROM os WHERE status = 'F' AND external_id NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R')",
)
_add(
    "has_child_nested", _all("orders", {"or": [_U, {"has_child": {"collection": "items", "field": "order", "query": {"and": [{"term": {"field": "flag", "value": "A"}}, {"range": {"field": "discount", "gte": 0.09}}]}}}]}, "items"),
    f"""WITH {ORDERS}, k AS (SELECT DISTINCT l_orderkey::VARCHAR AS external_id, 1 AS c FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.09),
x AS (SELECT external_id, (priority = '1-URGENT')::INT + coalesce(c, 0) AS n FROM os LEFT JOIN k USING (external_id)) SELECT external_id, n::DOUBLE AS score FROM x WHERE n > 0""",
)

# Vectors and fusion.
for _m, _c in (("cosine", "vectors"), ("dot", "vectors_dot"), ("l2", "vectors_l2")):
    _add(f"knn_{_m}", _page(_c, {"query": {"knn": {"field": "embedding", "vector": VECTORS["a"], "k": 25}}, "limit": 25}), _knn_sql(_m, "a", 25))
_add("knn_filtered", _page("vectors", {"query": {"and": [{"knn": {"field": "embedding", "vector": VECTORS["b"], "k": 15}}, {"range": {"field": "label", "lte": 3}}]}}), f"WITH x AS ({_knn_sql('cosine', 'b', 15, 'label <= 3')}) SELECT external_id, round(score + 1, 6) AS score FROM x")
_add("knn_not", _page("vectors", {"query": {"and": [{"knn": {"field": "embedding", "vector": VECTORS["b"], "k": 15}}, {"not": {"term": {"field": "label", "value": 2}}}]}}), f"WITH x AS ({_knn_sql('cosine', 'b', 15, 'label <> 2')}) SELECT external_id, round(score + 2, 6) AS score FROM x")
_add("knn_or", _all("vectors", {"or": [{"knn": {"field": "embedding", "vector": VECTORS["c"], "k": 10}}, {"term": {"field": "label", "value": 1}}]}), f"""WITH x AS ({_knn_sql('cosine', 'c', 10)}), l AS (SELECT vec_id::VARCHAR AS external_id, 1.0 AS one FROM embeddings WHERE label = 1)
SELECT external_id, round(coalesce(one, 0)::DOUBLE + coalesce(score, 0), 6) AS score FROM x FULL JOIN l USING (external_id)""")  # fmt: skip
_add(
    "knn_batch", lambda spark, d: _open(spark, d, "vectors").nearest("embedding", VECTORS, 10),
    "WITH " + ", ".join(f"{q} AS ({_knn_sql('cosine', q, 10)})" for q in VECTORS) + ", u AS (" + " UNION ALL ".join(f"SELECT '{q}' AS query_id, * FROM {q}" for q in VECTORS)
    + ") SELECT query_id, external_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, external_id)::INT AS rank FROM u",
)
_add(
    "knn_quantized", _page("vectors_sq", {"query": {"knn": {"field": "embedding", "vector": VECTORS["a"], "k": 20}}}),
    f"""WITH r AS (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings),
q AS (SELECT vec_id, list_transform(embedding, lambda x: round((x::DOUBLE - lo) / (hi - lo) * 255) * (hi - lo) / 255 + lo) AS e FROM embeddings, r)
SELECT vec_id::VARCHAR AS external_id, round(list_cosine_similarity(e, {_vec(VECTORS['a'])}) - 1, 6) AS score FROM q {_TOP.format(n=20)}""",
)
_add(
    "rrf", _page("docs", {"query": {"rrf": {"queries": [{"match": {"field": "text", "text": "the of", "op": "or"}}, {"hamming": {"field": "print", "hash": HASH, "max_distance": 32}}], "k": 60}}, "limit": 50}),
    f"""WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of'])}, h AS (SELECT external_id, round((64 - {_hamming(HASH)}) / 64.0::DOUBLE, 6) AS score FROM docs WHERE {_hamming(HASH)} <= 32),
l AS (SELECT external_id, row_number() OVER (ORDER BY score DESC, external_id) AS r FROM m UNION ALL SELECT external_id, row_number() OVER (ORDER BY score DESC, external_id) FROM h)
SELECT external_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM l GROUP BY external_id {_TOP.format(n=50)}""",
)
_add(
    "rrf_knn", _page("vectors", {"query": {"rrf": {"queries": [{"knn": {"field": "embedding", "vector": VECTORS[v], "k": 40}} for v in ("a", "b", "c")]}}, "limit": 60}),
    "WITH " + ", ".join(f"{q} AS ({_knn_sql('cosine', q, 40)})" for q in VECTORS) + ", l AS (" + " UNION ALL ".join(f"SELECT external_id, row_number() OVER (ORDER BY score DESC, external_id) AS r FROM {q}" for q in VECTORS)
    + f") SELECT external_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM l GROUP BY external_id {_TOP.format(n=60)}",
)

# Order, pages, totals.
_add("sort_number", _page("orders", {"query": _T, "sort": [{"field": "total", "order": "desc"}], "limit": 40}), f"WITH {ORDERS} SELECT external_id, total AS score FROM os WHERE status = 'F' ORDER BY total DESC, external_id LIMIT 40")
_add("sort_two_keys", _page("docs", {"query": {"not": {"term": {"field": "lang", "value": "xx"}}}, "sort": [{"field": "part", "missing": "first"}, {"field": "rare", "order": "desc", "missing": "last"}], "limit": 300}), f"WITH {DOCS} SELECT external_id, CASE WHEN part IS NOT NULL THEN 1.0 ELSE coalesce(rare, 0.0) END::DOUBLE AS score FROM docs ORDER BY part ASC NULLS FIRST, rare DESC NULLS LAST, external_id LIMIT 300")
_add("sort_exclude", _page("docs", {"query": {"exists": {"field": "n_chars"}}, "sort": [{"field": "rare"}, {"field": "lang", "order": "desc"}], "limit": 100, "offset": 30}), f"WITH {DOCS} SELECT external_id, rare AS score FROM docs WHERE rare IS NOT NULL ORDER BY rare, lang DESC, external_id LIMIT 100 OFFSET 30")
_add("page_offset", _page("docs", {"query": {"match": {"field": "text", "text": "the", "op": "or"}}, "limit": 20, "offset": 35}), f"WITH {DOCS}, {_bm25('docs', 'text', ['the'])} SELECT * FROM m {_TOP.format(n=20)} OFFSET 35")


def _second_page(name: str, body: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _open(spark, sf_dir, name)
        _, cursor = c.search(body).page()
        return c.search({**body, "cursor": cursor}).hits.select("external_id", "score")

    return run


_add("cursor_score", _second_page("docs", {"query": {"match": {"field": "text", "text": "the of", "op": "or"}}, "limit": 25}), f"WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of'])} SELECT * FROM m {_TOP.format(n=25)} OFFSET 25")
_add("cursor_sort", _second_page("docs", {"query": {"exists": {"field": "n_chars"}}, "sort": [{"field": "rare", "order": "desc", "missing": "first"}, {"field": "source"}], "limit": 150}), f"WITH {DOCS} SELECT external_id, coalesce(rare, 1.0)::DOUBLE AS score FROM docs ORDER BY rare DESC NULLS FIRST, source, external_id LIMIT 150 OFFSET 150")
_add("filter_only", _page("docs", {"filter": {"term": {"field": "lang", "value": "de"}}, "limit": 30}), f"WITH {DOCS} SELECT external_id, NULL::DOUBLE AS score FROM docs WHERE lang = 'de' ORDER BY external_id LIMIT 30")
_add("scoring_and_filter", _page("docs", {"scoring": {"match": {"field": "text", "text": "the of", "op": "or"}}, "filter": {"term": {"field": "source", "value": "src3"}}, "limit": 30}), f"WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of'])} SELECT m.* FROM m JOIN docs USING (external_id) WHERE source = 'src3' {_TOP.format(n=30)}")
_add("knn_split", _page("vectors", {"scoring": {"knn": {"field": "embedding", "vector": VECTORS["c"], "k": 12}}, "filter": {"terms": {"field": "label", "values": [1, 4]}}}), _knn_sql("cosine", "c", 12, "label IN (1, 4)"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of three requests, as they are reported."""
    c = _open(spark, sf_dir, "orders")
    rows = []
    for name, track in (("exact", "exact"), ("bounded", {"up_to": 100}), ("far", {"up_to": 10_000_000})):
        n, relation = c.search({"query": _T, "track_total": track}).total()
        rows.append((name, n, relation))
    return spark.createDataFrame(rows, "request string, total long, relation string")


_add("totals", _totals, """WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F') SELECT 'exact' AS request, n AS total, 'eq' AS relation FROM n
UNION ALL SELECT 'bounded', least(n, 100), CASE WHEN n > 100 THEN 'gte' ELSE 'eq' END FROM n UNION ALL SELECT 'far', n, 'eq' FROM n""")


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _open(spark, sf_dir, "orders").search_many([{"query": _T, "limit": 5}, {"query": {"term": {"field": "nope", "value": 1}}}, {"query": _U, "limit": 7}])
    out = None
    for i, f in enumerate(found):
        one = spark.createDataFrame([(i, f.code, None)], "item int, external_id string, score double") if isinstance(f, Exception) else f.hits.select(F.lit(i).alias("item"), "external_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


_add("multi_search", _many, f"""WITH {ORDERS}, a AS (SELECT external_id FROM os WHERE status = 'F' ORDER BY external_id LIMIT 5), b AS (SELECT external_id FROM os WHERE priority = '1-URGENT' ORDER BY external_id LIMIT 7)
SELECT 0 AS item, external_id, 1.0::DOUBLE AS score FROM a UNION ALL SELECT 1, 'unknown_field', NULL UNION ALL SELECT 2, external_id, 1.0 FROM b""")

# Groups.
_add("collapse", _page("docs", {"query": {"match": {"field": "text", "text": "the of", "op": "or"}}, "collapse": "source", "limit": 15}), f"WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of'])} SELECT source AS external_id, max(score) AS score FROM m JOIN docs USING (external_id) GROUP BY source ORDER BY 2 DESC, 1 LIMIT 15")
_add("child_roll_up", _page("items", {"query": {"and": [{"term": {"field": "flag", "value": "R"}}, {"range": {"field": "quantity", "gt": 45}}]}, "collapse": "order", "limit": 50}), "SELECT DISTINCT l_orderkey::VARCHAR AS external_id, 2.0::DOUBLE AS score FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 ORDER BY 1 LIMIT 50")
_add(
    "collapse_keep_ids", lambda spark, d: _open(spark, d, "docs").search({"scoring": {"match": {"field": "text", "text": "the of", "op": "or"}}, "collapse": {"field": "part"}, "limit": 60}).hits,
    f"""WITH {DOCS}, {_bm25('docs', 'text', ['the', 'of'])}, x AS (SELECT external_id, m.score, part, row_number() OVER (PARTITION BY part ORDER BY m.score DESC, external_id) AS r FROM m JOIN docs USING (external_id))
SELECT external_id, score, part AS collapse_key FROM x WHERE r = 1 OR part IS NULL {_TOP.format(n=60)}""",
)
_add(
    "duplicates", lambda spark, d: _open(spark, d, "orders").duplicates("cust", 10, limit=30)[0].select("value", "size", F.concat_ws(",", "ids").alias("ids")),
    f"WITH {ORDERS} SELECT cust AS value, count(*) AS size, string_agg(external_id, ',' ORDER BY external_id) AS ids FROM os GROUP BY cust HAVING count(*) >= 10 ORDER BY size DESC, '\"' || value || '\"' LIMIT 30",
)
_add("duplicate_members", lambda spark, d: _open(spark, d, "docs").duplicate_members("rare", 3), f"WITH {DOCS}, g AS (SELECT rare AS value, count(*) AS n FROM docs WHERE rare IS NOT NULL GROUP BY rare HAVING count(*) >= 3) SELECT value, n, external_id FROM docs JOIN g ON rare = value")
_add(
    "stats", lambda spark, d: _open(spark, d, "docs").stats().withColumn("avg_doc_len", F.round("avg_doc_len", 6)),
    f"""WITH {DOCS}, t AS (SELECT {_WORDS.format(c='text')} AS toks FROM docs WHERE text IS NOT NULL), v AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(toks) AS x FROM t))
SELECT 'text' AS field, (SELECT count(*) FROM t) AS documents, (SELECT n FROM v) AS unique_terms, (SELECT round(avg(len(toks)), 6) FROM t) AS avg_doc_len
""" + "".join(f" UNION ALL SELECT '{f}', count({f}), count(DISTINCT {e}), NULL FROM docs" for f, e in (("lang", "lang"), ("source", "source"), ("n_chars", "n_chars"), ("size", "size"), ("part", "part"), ("rare", "rare"), ("print", "substr(print, 1, 16)")))
    + " UNION ALL SELECT 'tags', (SELECT count(tags) FROM docs), count(DISTINCT x), NULL FROM (SELECT unnest(tags) AS x FROM docs)",
)
_add("audit", lambda spark, d: _open(spark, d, "docs").audit({"part": 10**9, "text": 1, "rare": 10**9}), f"WITH {DOCS} SELECT 'part' AS field, 1000000000::BIGINT AS expected, count(part) AS found FROM docs UNION ALL SELECT 'rare', 1000000000, count(rare) FROM docs")


# Facets and metrics.
def _facet(name: str, body: dict, what: str = "buckets") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: getattr(_open(spark, d, name).search({**body}).facets["f"], what)


_DE = {"filter": {"not": {"term": {"field": "lang", "value": "de"}}}}
_add("facet_terms", _facet("docs", {**_DE, "facets": {"f": {"kind": "terms", "field": "source", "size": 7}}}), f"WITH {DOCS} SELECT source AS value, count(*) AS count FROM docs WHERE lang <> 'de' GROUP BY source ORDER BY 2 DESC, 1 LIMIT 7")
_add("facet_set", _facet("docs", {**_DE, "facets": {"f": {"kind": "terms", "field": "tags", "order": "value_desc", "prefix": "src1", "min_count": 2, "size": 100}}}), f"WITH {DOCS}, e AS (SELECT DISTINCT external_id, unnest(tags) AS value FROM docs WHERE lang <> 'de') SELECT value, count(*) AS count FROM e WHERE starts_with(value, 'src1') GROUP BY value HAVING count(*) >= 2")
_add("facet_summary", _facet("docs", {**_DE, "facets": {"f": {"kind": "terms", "field": "part", "size": 4}}}, "summary"), f"WITH {DOCS}, h AS (SELECT * FROM docs WHERE lang <> 'de') SELECT count(DISTINCT part) AS distinct_value_count, count(DISTINCT part) > 4 AS truncated, count(*) - count(part) AS missing_count FROM h")
_BUCKETS = [{"key": "short", "to": 500}, {"key": "middle", "from": 500, "to": 2000}, {"key": "long", "from": 4000}]
_add("facet_ranges", _facet("docs", {**_DE, "facets": {"f": {"kind": "range", "field": "size", "buckets": _BUCKETS}}}), f"WITH {DOCS}, h AS (SELECT * FROM docs WHERE lang <> 'de') SELECT 'short' AS key, count(*) FILTER (size < 500) AS count FROM h UNION ALL SELECT 'middle', count(*) FILTER (size >= 500 AND size < 2000) FROM h UNION ALL SELECT 'long', count(*) FILTER (size >= 4000) FROM h")
_add("facet_ranges_summary", _facet("docs", {**_DE, "facets": {"f": {"kind": "range", "field": "rare", "buckets": [{"key": "x", "from": 10.0, "to": 20.0}]}}}, "summary"), f"WITH {DOCS} SELECT count(*) FILTER (rare IS NOT NULL AND NOT (rare >= 10 AND rare < 20)) AS unbucketed_document_count, count(*) FILTER (rare IS NULL) AS missing_count FROM docs WHERE lang <> 'de'")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {f"{k}_{f}": {"kind": k, "field": f} for f in ("price", "total") for k in facet_ops.METRICS}
    m = _open(spark, sf_dir, "orders").search({"filter": _R, "metrics": kinds}).metrics
    whole = [F.col(c) for c in m.columns if c not in ("sum_total", "avg_total", "sum_price", "avg_price", "min_price", "max_price")]
    text = lambda c, s: F.col(c).cast(f"decimal(38,{s})").cast("string").alias(c)
    return m.select(*whole, F.round("sum_total", 2).alias("sum_total"), F.round("avg_total", 4).alias("avg_total"), text("sum_price", 2), F.round(F.col("avg_price").cast("double"), 4).alias("avg_price"), text("min_price", 2), text("max_price", 2))


_add("metrics", _metrics, f"""WITH {ORDERS}, h AS (SELECT * FROM os WHERE total > 150000) SELECT count(price) AS count_price, count(price) AS value_count_price, count(total) AS count_total, count(total) AS value_count_total,
min(total) AS min_total, max(total) AS max_total, round(sum(total), 2) AS sum_total, round(avg(total), 4) AS avg_total, sum(price)::DECIMAL(38,2)::VARCHAR AS sum_price,
round(sum(price)::DOUBLE / count(price), 4) AS avg_price, min(price)::DECIMAL(38,2)::VARCHAR AS min_price, max(price)::DECIMAL(38,2)::VARCHAR AS max_price FROM h""")


# Hydration, functions, routing.
def _hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _open(spark, sf_dir, "orders")
    hits = c.search({"query": {"and": [_T, _U]}, "limit": 25}).hits
    source = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").cast("string").alias("external_id"), "o_totalprice")
    return c.hydrate(hits, source).select("rank", "external_id", "score", "o_totalprice", "found")


_add("hydrate", _hydrate, f"""WITH {ORDERS}, h AS (SELECT external_id, 2.0::DOUBLE AS score FROM os WHERE status = 'F' AND priority = '1-URGENT' ORDER BY external_id LIMIT 25)
SELECT row_number() OVER (ORDER BY h.external_id)::INT AS rank, h.external_id, score, o_totalprice, o_orderkey IS NOT NULL AS found FROM h LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON o_orderkey::VARCHAR = h.external_id""")
_add("analyze_words", lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(analyzers.whitespace_lower(F.col("text"))).alias("n"), F.md5(F.array_join(analyzers.whitespace_lower(F.col("text")), " ")).alias("tokens")), f"WITH t AS (SELECT doc_id, {_WORDS.format(c='text')} AS toks FROM documents) SELECT doc_id, len(toks)::INT AS n, md5(array_to_string(toks, ' ')) AS tokens FROM t")
_add("analyze_ngrams", lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_join(analyzers.ngram(F.col("p_name")), "|").alias("grams")), f"SELECT p_partkey, array_to_string({_GRAMS.format(s=_SQUEEZED.format(c='p_name'))}, '|') AS grams FROM part")
_add("strict_values", lambda spark, d: table(spark, d, "customer").select("c_custkey", values.strict_date(F.date_format(F.lit("2024-02-28").cast("date") + (F.col("c_custkey") % 3).cast("int"), "yyyy-MM-dd")).alias("day"), values.strict_decimal(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), 8, 2).alias("balance")), "SELECT c_custkey, DATE '2024-02-28' + (c_custkey % 3)::INT AS day, c_acctbal::DECIMAL(8,2) AS balance FROM customer")
_add(
    "unit_vectors", lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(F.get(vectors.normalized(F.col("embedding")), F.lit(0)), 6).alias("first"), F.round(vectors.norm(vectors.normalized(F.col("embedding"))), 6).alias("length")),
    "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 1.0::DOUBLE AS length FROM embeddings",
)


# Writes.
_EVENT_FIELDS = {"kind": "keyword", "value": "number"}


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as merges of two fields a user: later events win, or higher versions where there is one."""
    schema = Collection(spark.createDataFrame([], "external_id string, kind string, value double"), _EVENT_FIELDS).schema
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 97 == 0, "delete").when(F.col("event_id") % 7 == 0, "replace").otherwise("merge")
    items = F.when(op == "merge", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("kind"))).otherwise(F.array(F.lit("kind"), F.lit("value")))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("external_id"), F.lit(None).cast("long").alias("version"),
        F.struct(F.col("event_type").alias("kind"), F.col("value").alias("value")).alias("fields"), items.alias("items"), F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("timestamp").alias("at"),
    ), schema


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, schema = _changes(spark, sf_dir)
    return fold.live(fold.fold(fold.empty_state(spark, schema), changes, schema), schema)


_add("fold_changes", _folded, """WITH e AS (SELECT event_id AS seq, user_id::VARCHAR AS external_id, event_type AS kind, value, CASE WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 7 = 0 THEN 'replace' ELSE 'merge' END AS op FROM events),
w AS (SELECT external_id, max(seq) AS s FROM e WHERE op <> 'merge' GROUP BY external_id),
x AS (SELECT e.*, coalesce(w.s, -1) AS s FROM e LEFT JOIN w USING (external_id)),
y AS (SELECT external_id, arg_max(CASE WHEN op = 'delete' THEN NULL ELSE [kind] END, seq) FILTER (seq >= s) AS kind,
  arg_max(CASE WHEN op = 'delete' THEN [NULL] ELSE [value] END, seq) FILTER (seq >= s AND (op <> 'merge' OR seq % 2 <> 0)) AS value, arg_max(op, seq) AS last FROM x GROUP BY external_id),
z AS (SELECT external_id, CASE WHEN last = 'delete' THEN NULL ELSE kind[1] END AS kind, CASE WHEN last = 'delete' THEN NULL ELSE value[1] END AS value FROM y)
SELECT * FROM z WHERE kind IS NOT NULL OR value IS NOT NULL""")


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges that come out of order: the highest version of a cell wins, the first of equal ones."""
    changes, schema = _changes(spark, sf_dir)
    changes = changes.withColumn("op", F.lit("merge")).withColumn("items", F.array(F.lit("kind"), F.lit("value"))).withColumn("version", (F.col("seq") * 7919) % 1009)
    return fold.live(fold.fold(fold.empty_state(spark, schema), changes, schema), schema)


_add("fold_versions", _versioned, "SELECT user_id::VARCHAR AS external_id, arg_max(event_type, (event_id * 7919) % 1009 * 100000000 - event_id) AS kind, arg_max(value, (event_id * 7919) % 1009 * 100000000 - event_id) AS value FROM events GROUP BY user_id")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes as a stream, folded batch by batch into versions on storage."""
    changes, schema = _changes(spark, sf_dir)
    kind = fold.change_schema(schema)
    path = new_path(spark, "changes")
    typed = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind])
    # Two files by order, so that the stream has more than one batch to fold.
    half = typed.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    typed.where(F.col("seq") <= half).coalesce(1).write.parquet(f"{path}/in/a")
    typed.where(F.col("seq") > half).coalesce(1).write.parquet(f"{path}/in/b")
    versions = stream.Versions(spark, f"{path}/out", schema)
    for k, part in enumerate(("a", "b")):
        source = spark.readStream.schema(kind).parquet(f"{path}/in/{part}")
        query = stream.start(source, versions, f"{path}/checkpoint-{k}", once=True, first=k * 1000)
        query.awaitTermination()
    return versions.documents()


_add("fold_stream", _streamed, SQL["fold_changes"])


def _through_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _open(spark, sf_dir, "docs")
    path = new_path(spark, "postings")
    postings.build(c, "text", path)
    found = postings.search(spark, path, Match("text", "The, of THE", "and"))
    return found.select("external_id", F.round("score", DIGITS).alias("score"))


_add("postings_match", _through_postings, SQL["match_and_all"])


def _through_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines, every seventh with a date that does not exist, and read back with checks."""
    c = _open(spark, sf_dir, "orders")
    path = new_path(spark, "json")
    odd = F.col("external_id").cast("long") % 7 == 0
    wire = c.rows.withColumn("day", F.when(odd, F.lit("2023-02-30")).otherwise(F.col("day").cast("string"))).withColumn("price", F.col("price").cast("string"))
    wire.write.json(path)
    good, bad = json_lines.read_documents(spark, path, c.schema)
    both = good.select(F.lit("good").alias("kind"), "external_id", "day", F.col("price").cast("double").alias("price"))
    return both.unionByName(bad.select(F.col("fields")[0].alias("kind"), "external_id", F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("price")))


_add("json_lines", _through_json, f"""WITH {ORDERS} SELECT CASE WHEN external_id::BIGINT % 7 = 0 THEN 'day' ELSE 'good' END AS kind, external_id,
CASE WHEN external_id::BIGINT % 7 <> 0 THEN day END AS day, CASE WHEN external_id::BIGINT % 7 <> 0 THEN price::DOUBLE END AS price FROM os""")


def _through_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _open(spark, sf_dir, "customers")
    path = new_path(spark, "snapshot")
    snapshot.save(c, path)
    return snapshot.load(Catalog(spark), "copy", path).search_all({"query": {"range": {"field": "balance", "lt": 0}}}).select("external_id", "score")


_add("snapshot", _through_snapshot, f"WITH {CUSTOMERS} " + _one.format(t="cs", w="balance < 0"))
_add("point_lookup", lambda spark, d: _open(spark, d, "orders").value("7", "total"), "SELECT o_totalprice AS total FROM orders WHERE o_orderkey = 7")


# Routing and subsets. The SQL builds the checksum from its polynomial, a byte at a time.
_CRC = """k AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tbl),
b AS (SELECT *, list_concat(list_transform(range(1, length('customers') + 1), lambda i: ascii(substr('customers', i::BIGINT, 1))), [0], list_transform(range(1, length(external_id) + 1), lambda i: ascii(substr(external_id, i::BIGINT, 1)))) AS bytes FROM cs),
r AS (SELECT b.*, (xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, x: xor(c // 256, tbl[(xor(c, x) % 256) + 1])), 4294967295) % {n})::INT AS bucket FROM b, k)"""
_add("route", lambda spark, d: _open(spark, d, "customers").rows.select("external_id", values.route("customers", F.col("external_id"), 1024).alias("bucket")), f"WITH {CUSTOMERS}, {_CRC.format(n=1024)} SELECT external_id, bucket FROM r")


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard that gave buckets away and was given one back with other balances."""
    rows = _open(spark, sf_dir, "customers").rows
    own = snapshot.keep_buckets(rows, "customers", [0, 1, 2, 3, 4], 16)
    back = snapshot.of_buckets(rows, "customers", [4, 7], 16).withColumn("balance", F.lit(0.0))
    return snapshot.add_subset(own, back).select("external_id", "balance")


_add("bucket_subset", _moved, f"WITH {CUSTOMERS}, {_CRC.format(n=16)} SELECT external_id, CASE WHEN bucket IN (4, 7) THEN 0.0::DOUBLE ELSE balance END AS balance FROM r WHERE bucket <= 4 OR bucket = 7")

# Long lists of ids, the third analyzer, requests in their older form.
_add("ids_many", _all("orders", {"ids": {"values": [str(i) for i in range(1, 24001, 2)]}}), f"WITH {ORDERS} " + _one.format(t="os", w="external_id::BIGINT % 2 = 1 AND external_id::BIGINT < 24001"))
_add(
    "analyze_pairs", lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_join(analyzers.analyze(F.concat(F.lit("\u6f22\u5b57\u304b A\uac00 "), F.col("p_name")), "jieba"), "|").alias("tokens")),
    f"SELECT p_partkey, array_to_string(list_concat(['\u6f22\u5b57', '\u5b57\u304b', 'a', '\uac00'], {_WORDS.format(c='p_name')}), '|') AS tokens FROM part",
)
_add(
    "migrated", lambda spark, d: _open(spark, d, "docs").search(request.migrate({"query": {"and": [{"match": {"field": "text", "text": "the of", "op": "or"}}, {"term": {"field": "source", "value": "src3"}}]}, "limit": 30})).hits.select("external_id", "score"),
    SQL["scoring_and_filter"],
)
_add(
    "knn_quantized_filtered", _page("vectors_sq", {"query": {"and": [{"knn": {"field": "embedding", "vector": VECTORS["a"], "k": 15}}, {"range": {"field": "label", "lte": 3}}]}}),
    f"""WITH r AS (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings),
q AS (SELECT vec_id, list_transform(embedding, lambda x: round((x::DOUBLE - lo) / (hi - lo) * 255) * (hi - lo) / 255 + lo) AS e FROM embeddings, r WHERE label <= 3)
SELECT vec_id::VARCHAR AS external_id, round(list_cosine_similarity(e, {_vec(VECTORS['a'])}), 6) AS score FROM q {_TOP.format(n=15)}""",
)


# Writes that end or repeat others.
def _as_changes(spark: SparkSession, sf_dir: str, op: str, **more) -> tuple[DataFrame, object]:
    """The events as changes of another op, an SQL expression, and with other columns."""
    changes, schema = _changes(spark, sf_dir)
    changes = changes.withColumn("op", F.expr(op)).withColumn("items", F.array(F.lit("kind"), F.lit("value")))
    return changes.withColumns(more), schema


def _ended(op: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        changes, schema = _as_changes(spark, sf_dir, op)
        return fold.live(fold.fold(fold.empty_state(spark, schema), changes, schema), schema)

    return run


_LAST = "SELECT user_id::VARCHAR AS external_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM {t} GROUP BY user_id"
_add("fold_unindex", _ended("if(seq % 50 = 0, 'unindex', 'merge')"), f"WITH u AS (SELECT user_id AS k, max(event_id) AS u FROM events WHERE event_id % 50 = 0 GROUP BY user_id), x AS (SELECT * FROM events LEFT JOIN u ON user_id = k WHERE event_id > coalesce(u, -1)) {_LAST.format(t='x')}")
_add("fold_truncate", _ended("if(seq = 500, 'truncate', 'merge')"), f"WITH x AS (SELECT * FROM events WHERE event_id > 500) {_LAST.format(t='x')}")


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, schema = _as_changes(spark, sf_dir, "'replace'", version=(F.col("seq") * 7919) % 1009)
    return fold.live(fold.fold(fold.empty_state(spark, schema), changes, schema), schema)


_add("fold_doc_versions", _replaced, SQL["fold_versions"])


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, schema = _as_changes(spark, sf_dir, "'replace'", version=(F.col("seq") * 7919) % 1009)
    return fold.outcomes(fold.empty_state(spark, schema), changes)


_add("replace_outcomes", _outcomes, """WITH v AS (SELECT event_id AS seq, user_id::VARCHAR AS external_id, event_id * 7919 % 1009 AS version FROM events),
w AS (SELECT *, max(version) OVER (PARTITION BY external_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v)
SELECT seq, external_id, CASE WHEN version <= top THEN 'dropped' ELSE 'ok' END AS outcome FROM w""")


def _unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _open(spark, sf_dir, "customers")
    fields = [F.col(n) if n != "balance" else F.when(F.col("external_id").cast("long") % 3 == 0, F.col(n) + 1).otherwise(F.col(n)).alias(n) for n in c.schema.fields]
    return fold.unchanged(fold.as_state(c.rows, c.schema), c.rows.select("external_id", F.struct(*fields).alias("fields")), c.schema)


_add("unchanged_fields", _unchanged, f"WITH {CUSTOMERS}, w AS (SELECT external_id, (external_id::BIGINT % 3 = 0)::INT AS written FROM cs) SELECT external_id, written, 4 - written AS skipped FROM w")


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sends of each request, of which the second counts only when the first is forgotten."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 37 % 5000)
    changes, _ = _as_changes(spark, sf_dir, "'merge'", request_id=F.floor(F.col("seq") / 2).cast("string"), at=at)
    return fold.without_repeats(changes, 600).select("seq", "external_id")


_add("request_repeats", _repeated, """WITH e AS (SELECT event_id AS seq, user_id::VARCHAR AS external_id, event_id // 2 AS r, event_id * 37 % 5000 AS sent FROM events),
f AS (SELECT *, min(sent) OVER (PARTITION BY r) AS sent_first FROM e) SELECT seq, external_id FROM f WHERE sent = sent_first OR sent - sent_first > 600""")


def _without_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    catalog.declare("x", {"part": "keyword", "rare": "number"}, _open(spark, sf_dir, "docs").rows)
    return catalog.drop_field("x", "rare").rows


_add("drop_field", _without_field, f"WITH {DOCS} SELECT external_id, part FROM docs WHERE part IS NOT NULL")


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild in two chunks; ids of the second win."""
    catalog = open_catalog(spark, sf_dir, "customers")
    c = catalog["customers"]
    made = rebuild.Rebuild(catalog, "customers", c.schema, new_path(spark, "rebuild"))
    made.start()
    made.chunk(0, c.rows)
    made.chunk(1, c.rows.where(F.col("nation") < 9).withColumn("balance", F.col("balance") * 2))
    made.seal()
    return made.finish().rows.select("external_id", "balance")


_add("rebuild", _rebuilt, f"WITH {CUSTOMERS} SELECT external_id, CASE WHEN nation < 9 THEN balance * 2 ELSE balance END AS balance FROM cs")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q["filtered_match"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def migrated(body: dict) -> dict:
    """A one-tree request in the split form."""
    return request.migrate(body)
