import random

import pytest

from plumbline import QueryError
from plumbline.collection import Collection
from plumbline.plans import nodes as N

from . import brute

FIELDS = {"kw": "keyword", "n": "number", "tags": "set", "body": "text", "v": {"type": "vector", "dim": 3}}
DDL = "external_id string, kw string, n double, tags array<string>, body string, v array<float>"


def _docs(rng, n):
    out = []
    for i in range(n):
        some = lambda make: make() if rng.random() < 0.8 else None  # noqa: B023, E731
        out.append(
            {
                "external_id": f"d{i}",
                "kw": some(lambda: rng.choice("abcd")),
                "n": some(lambda: float(rng.randrange(20))),
                "tags": some(lambda: sorted(set(rng.choices("pqrs", k=rng.randrange(1, 4))))),
                "body": some(lambda: " ".join(rng.choices(["red", "Fox,", "blue", "(dog)", "the"], k=rng.randrange(0, 7)))),
                "v": some(lambda: [float(rng.randrange(-3, 4)) for _ in range(3)]),
            }
        )
    return [d for d in out if any(v is not None for k, v in d.items() if k != "external_id")]


def _leaf(rng):
    return rng.choice(
        [
            lambda: N.Term("kw", rng.choice("abcz")),
            lambda: N.Term("n", rng.randrange(20)),
            lambda: N.Term("tags", rng.choice("pqz")),
            lambda: N.Terms("tags", tuple(rng.sample("pqrs", 2))),
            lambda: N.Terms("kw", tuple(rng.sample("abcd", 2))),
            lambda: N.Prefix("kw", rng.choice("ab")),
            lambda: N.Ids(tuple(f"d{rng.randrange(30)}" for _ in range(3))),
            lambda: N.Exists(rng.choice(["kw", "n", "tags"])),
            lambda: N.Range("n", **{rng.choice(["gt", "gte"]): rng.randrange(15), rng.choice(["lt", "lte"]): rng.randrange(20)}),
            lambda: N.Range("kw", gte="b"),
            lambda: N.Duplicated(rng.choice(["kw", "n", "tags"]), rng.randrange(1, 6)),
            lambda: N.Match("body", " ".join(rng.choices(["fox", "Red", "the", "cat"], k=rng.randrange(0, 3))), rng.choice(["and", "or"])),
            lambda: N.Knn("v", tuple(float(rng.randrange(-3, 4)) + 0.25 for _ in range(3)), rng.randrange(0, 6)),
        ]
    )()


def _tree(rng, depth=0):
    if depth > 2 or rng.random() < 0.35:
        return _leaf(rng)
    kind = rng.choice(["and", "and", "or", "not"])
    if kind == "not":
        return N.Not(_tree(rng, depth + 1))
    some = tuple(_tree(rng, depth + 1) for _ in range(rng.randrange(0 if depth else 1, 4)))
    return N.And(some) if kind == "and" else N.Or(some)


@pytest.mark.parametrize("seed", range(24))
def test_random_trees_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = _docs(rng, 30)
    rows = spark.createDataFrame([tuple(d.values()) for d in docs], DDL)
    c = Collection(rows, FIELDS)
    tree = _tree(rng)
    assert N.parse(N.to_json(tree)) == tree
    got = {r.external_id: r.score for r in c.search_all({"query": N.to_json(tree)}).collect()}
    assert got == pytest.approx(brute.run(tree, docs), abs=1e-9), N.to_json(tree)


def test_fusion_of_wide_and_narrow_legs(spark):
    rng = random.Random(5)
    docs = _docs(rng, 60)
    c = Collection(spark.createDataFrame([tuple(d.values()) for d in docs], DDL), FIELDS, digits=9)
    tree = N.Rrf((N.Match("body", "red fox", "or"), N.Knn("v", (1.25, 0.5, -2.0), 7), N.Term("kw", "a")), 5)
    got = {r.external_id: r.score for r in c.search_all({"query": N.to_json(tree)}).collect()}
    assert got == pytest.approx(brute.run(tree, docs), abs=1e-8)


def test_a_fused_hit_beats_a_hit_of_one_leg(spark):
    rows = spark.createDataFrame([("one", "x x", None), ("both", "x", "y")], "external_id string, f1 string, f2 string")
    c = Collection(rows, {"f1": "text", "f2": "text"})
    legs = [{"match": {"field": "f1", "text": "x"}}, {"match": {"field": "f2", "text": "y"}}]
    got = c.search({"query": {"rrf": {"queries": legs}}}).hits.collect()
    assert [r.external_id for r in got] == ["both", "one"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_hamming_thresholds(spark):
    bits = [0xFF00FF00FF00FF00, 0xFF00FF00FF00FF01, 0xFF00FF00FF00FFFF, 0x00FF00FF00FF00FF]
    rows = spark.createDataFrame([(f"i{k}", f"0x{b:016X}" if k % 2 else f"{b:x}", "k") for k, b in enumerate(bits)], "external_id string, ph string, kind string")
    c = Collection(rows, {"ph": "hash", "kind": "keyword"})
    find = lambda d: [(r.external_id, r.score) for r in c.search({"query": {"hamming": {"field": "ph", "hash": f"{bits[0]:x}", "max_distance": d}}}).hits.collect()]
    assert [len(find(d)) for d in (4, 8, 64, 1000)] == [2, 3, 4, 4]
    assert find(64) == [("i0", 1.0), ("i1", 63 / 64), ("i2", 56 / 64), ("i3", 0.0)]


def test_children(spark):
    from plumbline.catalog import Catalog

    cat = Catalog(spark)
    cat.declare("p", {"name": "keyword"}, spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "c")], "external_id string, name string"))
    kids = [("c1", "p1", "s1", 5.0), ("c2", "p1", "s2", 1.0), ("c3", "p2", "s1", 1.0), ("c4", "gone", "s1", 9.0), ("c5", None, "s1", 9.0)]
    cat.declare("k", {"owner": "keyword", "code": "keyword", "amount": "number"}, spark.createDataFrame(kids, "external_id string, owner string, code string, amount double"))
    child = lambda q: {"has_child": {"collection": "k", "field": "owner", "query": q}}
    ids = lambda q: sorted((r.external_id, r.score) for r in cat["p"].search_all({"query": q}).collect())
    both = {"and": [{"term": {"field": "code", "value": "s2"}}, {"range": {"field": "amount", "gt": 3}}]}
    assert ids(child(both)) == []  # never across two children
    assert ids(child({"range": {"field": "amount", "gte": 1}})) == [("p1", 1.0), ("p2", 1.0)]
    assert ids({"not": child({"term": {"field": "code", "value": "s1"}})}) == [("p3", 1.0)]
    assert ids({"and": [child({"term": {"field": "code", "value": "s1"}}), {"not": child(both)}, {"exists": {"field": "name"}}]}) == [("p1", 3.0), ("p2", 3.0)]
    with pytest.raises(QueryError, match="collection_not_found"):
        ids({"has_child": {"collection": "none", "field": "owner", "query": both}})


@pytest.mark.parametrize(
    "query, code",
    [
        ({"term": {"field": "nope", "value": 1}}, "unknown_field"),
        ({"term": {"field": "kw", "value": 1}}, "type_mismatch"),
        ({"terms": {"field": "tags", "values": ["a", 1]}}, "type_mismatch"),
        ({"term": {"field": "body", "value": "x"}}, "type_mismatch"),
        ({"prefix": {"field": "kw", "value": ""}}, "bad_request"),
        ({"prefix": {"field": "n", "value": "1"}}, "type_mismatch"),
        ({"range": {"field": "n", "gt": "a"}}, "type_mismatch"),
        ({"range": {"field": "n", "gt": float("nan")}}, "invalid_number"),
        ({"exists": {"field": "body"}}, "type_mismatch"),
        ({"match": {"field": "kw", "text": "x"}}, "type_mismatch"),
        ({"knn": {"field": "v", "vector": [1.0], "k": 1}}, "type_mismatch"),
        ({"knn": {"field": "v", "vector": [1.0, 0.0, 0.0], "k": 10001}}, "query_too_complex"),
        ({"terms": {"field": "kw", "values": ["x"] * 1025}}, "query_too_complex"),
        ({"and": [{"exists": {"field": "kw"}}] * 1100}, "query_too_complex"),
        ({"what": {}}, "bad_request"),
        ({"term": {"field": "kw", "value": "a", "boost": 2}}, "bad_request"),
    ],
)
def test_requests_that_are_refused(spark, query, code):
    c = Collection(spark.createDataFrame([], DDL), FIELDS)
    with pytest.raises(QueryError) as e:
        c.search({"query": query})
    assert e.value.code == code


def test_a_tree_that_is_too_deep(spark):
    q = {"exists": {"field": "kw"}}
    for _ in range(40):
        q = {"not": q}
    with pytest.raises(QueryError, match="query_too_complex"):
        Collection(spark.createDataFrame([], DDL), FIELDS).search({"query": q})


def test_plans(spark):
    """Predicates reach the scan beside the scores, pages are a bounded heap, statistics a subquery."""
    c = Collection(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) external_id", "text", "lang", "cast(n_chars as double) n"), {"text": "text", "lang": "keyword", "n": "number"})
    q = {"and": [{"match": {"field": "text", "text": "the", "op": "or"}}, {"term": {"field": "lang", "value": "en"}}, {"range": {"field": "n", "lt": 900}}]}
    plan = c.search({"query": q}).hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Subquery" in plan
    assert "EqualTo(lang,en)" in plan and "source" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_stored_postings_answer_like_texts(spark):
    r = random.Random(11)
    vocab = ["red", "reed", "read", "blue", "green", "the", "of", "a"]
    rows = [(str(i), None if i % 9 == 0 else " ".join(r.choices(vocab, k=r.choice([0, 1, 4, 12]))), r.randrange(4)) for i in range(120)]
    plain = Collection(spark.createDataFrame(rows, "external_id string, body string, n long"), {"body": "text", "n": "int64"}, digits=9)
    stored = plain.indexed()
    match = lambda text, op="and": {"match": {"field": "body", "text": text, "op": op}}
    few = {"range": {"field": "n", "lt": 2}}
    for q in (
        match("the of THE", "or"), match("red the"), match("none here", "or"), match("", "or"), {"phrase": {"field": "body", "text": "the of"}}, {"phrase": {"field": "body", "text": "the the of"}},
        {"fuzzy": {"field": "body", "value": "red", "max_edits": 1}}, {"and": [match("red"), few]}, {"or": [match("red"), few]}, {"and": [few, {"not": match("blue")}]}, {"not": match("the of", "or")},
        {"rrf": {"queries": [match("red blue", "or"), match("the", "or")], "k": 60}}, {"bool": {"should": [match("red"), match("green")], "must_not": [match("of")], "minimum_should_match": 1}},
    ):
        want, got = ({h.external_id: h.score for h in c.search_all({"query": q}).collect()} for c in (plain, stored))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want), q
    both = {"scoring": match("the of", "or"), "filter": {"and": [few, match("red", "or")]}}
    assert [tuple(h) for h in stored.search(both).hits.collect()] == [tuple(h) for h in plain.search(both).hits.collect()]
