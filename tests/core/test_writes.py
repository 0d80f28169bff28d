import random
from datetime import datetime, timedelta

import pytest

from plumbline import QueryError
from plumbline.catalog import Catalog
from plumbline.collection import Collection
from plumbline.schema import CollectionSchema
from plumbline.sources import json_lines, postings, snapshot
from plumbline.plans import nodes as N
from plumbline.streaming import fold, stream

SCHEMA = CollectionSchema.of({"a": "keyword", "n": "number", "s": "set"})


class Model:
    """Changes applied one by one."""

    def __init__(self):
        self.docs, self.cells, self.whole = {}, {}, {}

    def apply(self, c):
        op, i, v, f = c["op"], c.get("external_id"), c.get("version"), c.get("fields") or {}
        if op == "truncate":
            self.__init__()
        elif op == "unindex":
            for d in (self.docs, self.cells, self.whole):
                d.pop(i, None)
        elif op == "delete":
            for n in c.get("items") or SCHEMA.fields:
                self.docs.get(i, {}).pop(n, None)
        elif op == "replace":
            if v is not None:
                if self.whole.get(i) is not None and self.whole[i] >= v:
                    return
                self.whole[i] = v
            self.docs[i] = {n: x for n, x in f.items() if x != []}
        else:
            for n, x in f.items():
                if x == [] or (v is not None and self.cells.get(i, {}).get(n, -1) >= v):
                    continue
                if v is not None:
                    self.cells.setdefault(i, {})[n] = v
                self.docs.setdefault(i, {})[n] = x

    def live(self):
        return {i: d for i, d in self.docs.items() if d}


def _random_changes(rng, n, seq0=0):
    out = []
    for k in range(n):
        op = rng.choices(["merge", "replace", "delete", "unindex", "truncate"], [10, 4, 2, 1, 0.3])[0]
        fields = {}
        if op in ("merge", "replace"):
            for name, make in (("a", lambda: rng.choice("xyz")), ("n", lambda: float(rng.randrange(9))), ("s", lambda: rng.choice([[], ["p"], ["p", "q"]]))):
                if rng.random() < 0.6:
                    fields[name] = make()
        items = [rng.choice("ans")] if op == "delete" and rng.random() < 0.6 else []
        version = rng.randrange(12) if op in ("merge", "replace") and rng.random() < 0.6 else None
        out.append({"seq": seq0 + k, "op": op, "external_id": None if op == "truncate" else f"d{rng.randrange(6)}", "version": version, "fields": fields, "items": items})
    return out


def _docs(df):
    return {r.external_id: {n: r[n] for n in SCHEMA.fields if r[n] is not None} for r in df.collect()}


@pytest.mark.parametrize("seed", range(8))
def test_fold_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    model, state = Model(), fold.empty_state(spark, SCHEMA)
    for part in range(3):
        changes = _random_changes(rng, 40, 40 * part)
        for c in changes:
            model.apply(c)
        state = fold.fold(state, fold.merge_rows(spark, SCHEMA, rng.sample(changes, len(changes))), SCHEMA)
        state = spark.createDataFrame(state.collect(), fold.state_schema(SCHEMA))
        assert _docs(fold.live(state, SCHEMA)) == model.live()


def test_outcomes_and_unchanged_fields(spark):
    put = lambda seq, i, v, **f: {"seq": seq, "op": "replace", "external_id": i, "version": v, "fields": f}
    state = fold.fold(fold.empty_state(spark, SCHEMA), fold.merge_rows(spark, SCHEMA, [put(1, "x", 5, a="p", n=1)]), SCHEMA)
    more = fold.merge_rows(spark, SCHEMA, [put(2, "x", 5, a="q"), put(3, "x", 6, a="p", n=2), {"seq": 4, "op": "unindex", "external_id": "x"}, put(5, "x", 1, a="z"), put(6, "y", None, n=3)])
    assert {r.seq: r.outcome for r in fold.outcomes(state, more).collect()} == {2: "dropped", 3: "ok", 5: "ok", 6: "ok"}
    assert tuple(fold.unchanged(state, more.where("seq = 3"), SCHEMA).first()) == ("x", 1, 1)


def test_a_request_sent_again_counts_once(spark):
    t0 = datetime(2024, 1, 1)
    sent = [(0, 0), (1, 200), (2, 400), (3, 650), (4, 701)]  # the repeat at 200 s does not prolong the first
    rows = [{"seq": s, "op": "merge", "external_id": f"d{s}", "fields": {"n": 1}, "request_id": "r", "at": t0 + timedelta(seconds=t)} for s, t in sent]
    rows.append({"seq": 9, "op": "merge", "external_id": "free", "fields": {"n": 1}, "at": t0})
    kept = fold.without_repeats(fold.merge_rows(spark, SCHEMA, rows))
    assert sorted(r.seq for r in kept.collect()) == [0, 2, 4, 9]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    changes = _random_changes(rng, 90)
    for k, c in enumerate(changes):
        c["at"] = datetime(2024, 1, 1) + timedelta(seconds=k)
    df = fold.merge_rows(spark, SCHEMA, changes)
    for k in range(3):
        df.where(f"seq div 30 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    versions = stream.Versions(spark, str(tmp_path / "out"), SCHEMA)
    for k in range(3):
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / f"p{k}"))
        q = stream.start(source, stream.Versions(spark, str(tmp_path / f"v{k}"), SCHEMA), str(tmp_path / f"c{k}"), once=True)
        q.awaitTermination()
        assert q.exception() is None
        stream.apply(versions, spark.read.parquet(str(tmp_path / "in" / f"p{k}")), k)
        stream.apply(versions, spark.read.parquet(str(tmp_path / "in" / f"p{k}")), k)  # a replay changes nothing
    model = Model()
    for c in changes:
        model.apply(c)
    assert _docs(versions.documents()) == model.live()
    first = Model()
    for c in changes[:30]:
        first.apply(c)
    assert _docs(stream.Versions(spark, str(tmp_path / "v0"), SCHEMA).documents()) == first.live()


def test_json_lines(spark, tmp_path):
    schema = CollectionSchema.of({"d": "date", "v": {"type": "vector", "dim": 2}, "s": "set", "p": {"type": "decimal", "precision": 5, "scale": 2}, "h": "hash", "n": "number"})
    lines = [
        '{"external_id": "a", "d": "2024-02-29", "v": [1, 2], "s": ["x", "x"], "p": "1.50", "h": "0xff", "n": 2}',
        '{"external_id": "b", "d": "2023-02-29"}',
        '{"external_id": "c", "v": [1]}',
        "{not json",
        '{"external_id": "e", "s": [], "n": 3}',
        '{"n": 4}',
        '{"external_id": "g", "p": "1.555", "h": "zz"}',
    ]
    (tmp_path / "in.json").write_text("\n".join(lines))
    good, bad = json_lines.read_documents(spark, str(tmp_path / "in.json"), schema)
    rows = {r.external_id: r for r in good.collect()}
    assert set(rows) == {"a", "e"} and rows["a"].s == ["x"] and rows["e"].s is None
    assert sorted((r.external_id or "", tuple(r.fields), r.code) for r in bad.collect()) == [("", ("*",), "bad_request"), ("", ("external_id",), "type_mismatch"), ("b", ("d",), "type_mismatch"), ("c", ("v",), "type_mismatch"), ("g", ("p", "h"), "type_mismatch")]


def test_snapshots_and_subsets(spark, tmp_path):
    cat = Catalog(spark)
    rows = spark.createDataFrame([(f"d{i}", "xy"[i % 2], float(i)) for i in range(50)], "external_id string, a string, n double")
    c = cat.declare("c", {"a": "keyword", "n": "number"}, rows)
    snapshot.save(c, str(tmp_path / "s"))
    back = snapshot.load(Catalog(spark), "c", str(tmp_path / "s"))
    assert back.schema == c.schema and sorted(back.rows.collect()) == sorted(rows.collect())
    low = snapshot.of_buckets(rows, "c", list(range(2048)))
    high = snapshot.keep_buckets(rows, "c", list(range(2048, 4096)))
    assert low.count() + high.count() == 50 and low.count() > 0
    assert sorted(snapshot.add_subset(high, low).collect()) == sorted(rows.collect())
    owner = snapshot.split_shards([b % 3 for b in range(4096)], 3)
    assert max(owner.count(s) for s in range(4)) - min(owner.count(s) for s in range(4)) <= 3
    assert all(o == b % 3 or o == 3 for b, o in enumerate(owner))


def test_postings_answer_like_the_collection(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) external_id", "text")
    c = Collection(docs, {"text": "text"})
    postings.build(c, "text", str(tmp_path / "p"))
    for text_, op in (("the of", "or"), ("The of the", "and"), ("nothingatall", "or")):
        want = {r.external_id: r.score for r in c.search_all({"query": {"match": {"field": "text", "text": text_, "op": op}}}).collect()}
        got = {r.external_id: r.score for r in postings.search(spark, str(tmp_path / "p"), N.Match("text", text_, op)).collect()}
        assert got == pytest.approx(want)


def test_declarations(spark):
    cat = Catalog(spark)
    with pytest.raises(QueryError, match="invalid_collection_name"):
        cat.declare("a:b", {})
    c = cat.declare("c", {"a": "keyword"}, spark.createDataFrame([("x", "1"), ("y", None)], "external_id string, a string"))
    assert cat.declare("c", {"a": "keyword"}).schema.version == 1
    c = cat.declare("c", {"n": {"type": "number"}, "t": "text"})
    assert c.schema.version == 2 and c.schema["t"].analyzer == "whitespace_lower" and c.rows.where("n is null").count() == 2
    for bad in ({"a": "number"}, {"v": "vector"}, {"v": {"type": "vector", "dim": 3, "quantize": "pq"}}, {"k": {"type": "keyword", "analyzer": "ngram"}}, {"": "text"}):
        with pytest.raises(QueryError):
            cat.declare("c", bad)
    with pytest.raises(QueryError, match="shadow_rebuild_required"):
        cat.declare("c", {"a": {"type": "keyword", "facetable": True}})
    assert cat.declare("c", {"n": {"type": "number", "facetable": True}}).schema.version == 3
    assert [r.external_id for r in cat.drop_field("c", "n").rows.collect()] == ["x"]
    cat.drop("c")
    with pytest.raises(QueryError, match="gone"):
        cat["c"]
    assert cat.declare("c", {"a": "keyword"}).schema.version == 5 and cat["c"].rows.count() == 0
    assert CollectionSchema.from_json(c.schema.to_json()) == c.schema


def test_duplicates_and_stats(spark):
    rows = spark.createDataFrame([("a", "x", ["p", "q"]), ("b", "x", ["q"]), ("c", "y", None), ("d", "x", ["q", "p"])], "external_id string, k string, s array<string>")
    c = Collection(rows, {"k": "keyword", "s": "set"})
    groups, every = c.duplicates("s", 2, limit=1)
    assert [(r.value, r["size"], r.ids) for r in groups.collect()] == [("q", 3, ["a", "b", "d"])] and every.count() == 2
    assert {r.field: (r.documents, r.unique_terms) for r in c.stats().collect()} == {"k": (4, 2), "s": (3, 2)}


def test_a_rebuild_takes_chunks_in_order_and_switches_once(spark, tmp_path):
    from plumbline.streaming.rebuild import Rebuild

    cat = Catalog(spark)
    make = lambda *rows: spark.createDataFrame(rows, "external_id string, a string")
    cat.declare("c", {"a": "keyword"}, make(("old", "x")))
    r = Rebuild(cat, "c", cat["c"].schema, str(tmp_path / "shadow"))
    with pytest.raises(QueryError):
        r.chunk(0, make(("d", "1")))
    r.start()
    r.chunk(0, make(("d", "1"), ("e", "1")))
    for wrong in (0, 2):
        with pytest.raises(QueryError):
            r.chunk(wrong, make(("d", "9")))
    r.chunk(1, make(("d", "2")))
    assert (r.chunks, r.documents, [x.external_id for x in cat["c"].rows.collect()]) == (2, 3, ["old"])
    r.seal()
    assert sorted(map(tuple, r.finish().rows.collect())) == [("d", "2"), ("e", "1")]
    for move in (r.start, r.seal, r.cancel):
        with pytest.raises(QueryError):
            move()
    other = Rebuild(cat, "c", cat["c"].schema, str(tmp_path / "other"))
    other.fail("no space")
    assert other.phase == "failed" and other.reason == "no space"
