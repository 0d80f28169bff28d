import itertools

import pytest

from plumbline import QueryError
from plumbline.collection import Collection
from plumbline.plans import request

ROWS = [(f"d{i:02d}", None if i % 3 == 0 else float(i % 5), None if i % 4 == 0 else "xyz"[i % 3], f"w {'w ' * (i % 4)}") for i in range(37)]


@pytest.fixture(scope="module")
def c(spark):
    rows = spark.createDataFrame(ROWS, "external_id string, n double, k string, t string")
    return Collection(rows, {"n": "number", "k": {"type": "keyword", "facetable": True}, "t": "text"}, digits=9)


def _walk(c, body):
    seen, cursor = [], None
    while True:
        rows, cursor = c.search({**body, **({"cursor": cursor} if cursor else {})}).page()
        seen += [r.external_id for r in rows]
        if cursor is None or not rows:
            return seen


def _expected(keys):
    rows = [r for r in ROWS if all(not (m == "exclude" and r[f] is None) for f, _, m in keys)]
    for f, desc, m in [(0, False, "last"), *keys[::-1]]:
        have = sorted([r for r in rows if r[f] is not None], key=lambda r: r[f], reverse=desc) if not desc else _stable_desc([r for r in rows if r[f] is not None], f)
        none = [r for r in rows if r[f] is None]
        rows = none + have if m == "first" else have + none
    return [r[0] for r in rows]


def _stable_desc(rows, f):
    return [r for _, g in sorted(((k, list(g)) for k, g in itertools.groupby(sorted(rows, key=lambda r: r[f]), key=lambda r: r[f])), key=lambda x: x[0], reverse=True) for r in g]


@pytest.mark.parametrize("order1, missing1, order2, missing2", [("asc", "first", "desc", "last"), ("desc", "last", "asc", "exclude"), ("desc", "first", "asc", "first"), ("asc", "exclude", "desc", "first")])
def test_a_walk_over_sorted_pages_sees_every_row_once(c, order1, missing1, order2, missing2):
    sort = [{"field": "n", "order": order1, "missing": missing1}, {"field": "k", "order": order2, "missing": missing2}]
    want = _expected([(1, order1 == "desc", missing1), (2, order2 == "desc", missing2)])
    body = {"query": {"not": {"ids": {"values": []}}}, "sort": sort}
    assert _walk(c, {**body, "limit": 10}) == want
    assert [r.external_id for r in c.search({**body, "limit": 9, "offset": 4}).hits.collect()] == want[4:13]


def test_a_walk_over_ranked_pages(c):
    body = {"query": {"match": {"field": "t", "text": "w"}}, "limit": 8}
    whole = [r.external_id for r in c.search({**body, "limit": 100}).hits.collect()]
    assert len(whole) == 37 and _walk(c, body) == whole
    collapsed = {"query": {"match": {"field": "t", "text": "w"}}, "collapse": "k", "limit": 2}
    assert len(_walk(c, collapsed)) == 3


def test_totals(c):
    q = {"query": {"exists": {"field": "n"}}}
    n = sum(r[1] is not None for r in ROWS)
    total = lambda t: c.search({**q, "track_total": t}).total()
    assert (total(True), total(False), total({"up_to": 5}), total({"up_to": n})) == ((n, "eq"), None, (5, "gte"), (n, "eq"))
    assert c.search({**q, "collapse": "k"}).total() == (2, "eq")  # no x among those with an n


def test_facets_and_metrics(c):
    found = c.search({"facets": {"k": {"kind": "terms", "field": "k"}, "n": {"kind": "range", "field": "n", "buckets": [{"key": "low", "to": 2.0}, {"key": "high", "from": 3.0}]}}, "metrics": {"s": {"kind": "sum", "field": "n"}, "m": {"kind": "avg", "field": "n"}}, "limit": 1})
    ks = [r[2] for r in ROWS if r[2]]
    want = sorted(((k, ks.count(k)) for k in set(ks)), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in found.facets["k"].buckets.collect()] == want
    assert found.facets["k"].summary.first().asDict() == {"distinct_value_count": 3, "truncated": False, "missing_count": 37 - len(ks)}
    ns = [r[1] for r in ROWS if r[1] is not None]
    assert [tuple(r) for r in found.facets["n"].buckets.collect()] == [("low", sum(x < 2 for x in ns)), ("high", sum(x >= 3 for x in ns))]
    assert found.facets["n"].summary.first().unbucketed_document_count == ns.count(2.0)
    assert tuple(found.metrics.first()) == (sum(ns), pytest.approx(sum(ns) / len(ns)))
    none = c.search({"filter": {"ids": {"values": ["no"]}}, "metrics": {k: {"kind": k, "field": "n"} for k in ("count", "sum", "avg", "min")}})
    assert tuple(none.metrics.first()) == (0, None, None, None)


@pytest.mark.parametrize(
    "body, code",
    [
        ({"limit": 1001}, "invalid_pagination"),
        ({"offset": 10001}, "invalid_pagination"),
        ({"offset": 1, "cursor": "x"}, "invalid_pagination"),
        ({"sort": []}, "unsupported_sort"),
        ({"sort": [{"field": "n"}] * 5}, "unsupported_sort"),
        ({"sort": [{"field": "t"}]}, "unsupported_sort"),
        ({"sort": [{"field": "n"}], "collapse": "k"}, "unsupported_sort"),
        ({"nope": 1}, "bad_request"),
        ({"track_total": "some"}, "bad_request"),
        ({"collapse": "n"}, "type_mismatch"),
        ({"facets": {"9x": {}}}, "bad_request"),
    ],
)
def test_refused_requests(c, body, code):
    with pytest.raises(QueryError) as e:
        c.search({"query": {"exists": {"field": "n"}}, **body})
    assert e.value.code == code


def test_an_unreadable_cursor_is_the_first_page(c):
    q = {"query": {"exists": {"field": "n"}}, "limit": 4}
    assert c.search({**q, "cursor": "!!"}).hits.collect() == c.search(q).hits.collect()


def test_migration_to_the_split_form():
    term, match = {"term": {"field": "k", "value": "x"}}, {"match": {"field": "t", "text": "w", "op": "and"}}
    out = request.migrate({"query": {"and": [match, term]}, "track_total": True, "collapse": "k", "limit": 3})
    assert out == {"scoring": match, "filter": term, "track_total": "exact", "collapse": {"field": "k"}, "limit": 3}
    for bad in ({"query": {"or": [match, term]}}, {"query": term, "sort": [{"field": "n"}]}, {"query": term, "cursor": "x"}):
        with pytest.raises(QueryError):
            request.migrate(bad)


def test_hydration_reports_what_is_absent(spark, c):
    hits = c.search({"query": {"ids": {"values": ["d01", "d02", "d03"]}}}).hits
    source = spark.createDataFrame([("d01", 1), ("d03", 3)], "external_id string, x int")
    rows = c.hydrate(hits, source).orderBy("rank").collect()
    assert [(r.external_id, r.x, r.found) for r in rows] == [("d01", 1, True), ("d02", None, False), ("d03", 3, True)]
