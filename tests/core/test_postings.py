import random

import pyarrow as pa
import pytest
from plumbline.collection import Collection
from plumbline.plans import nodes as N
from plumbline.sources import postings

DOCS = ["the red fox", "", "of the of the", None, "Grün grun zebra", "the", "red reed read red"]


def test_an_index_reads_its_rows_once_and_shuffles_nothing(spark, tmp_path):
    r = random.Random(5)
    rows = spark.createDataFrame([(str(i), r.choices(["a", "b", "c", "d"], k=r.randrange(9))) for i in range(300)], "external_id string, tokens array<string>")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    plans = []
    write = type(rows.write).parquet
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows.write), "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **k))
        postings.write(rows.mapInArrow(count, rows.schema), str(tmp_path / "p"))
    assert seen.value == 300
    assert plans and not any("Exchange" in p or "Sort" in p for p in plans)


def test_segments_hold_every_place_of_every_token(monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 40)
    monkeypatch.setattr(postings, "HANDED", 3)
    r = random.Random(3)
    docs = [(str(i), r.choices(["a", "b", "é", "zz", "漢"], k=r.choice([0, 1, 7, 90]))) for i in range(50)]
    parts = [docs[:30], docs[30:31], docs[31:]]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in p]), pa.array([t for _, t in p], pa.list_(pa.string()))], ["external_id", "tokens"]) for p in parts]
    want, got, n, total, segments = {}, {}, 0, 0, 0
    for i, tokens in docs:
        for at, t in enumerate(tokens):
            want.setdefault((t, i, len(tokens)), []).append(at)
    last = None
    for b in postings._segments(iter(batches)):
        assert len(b) <= 3
        for row in b.to_pylist():
            if row["token"] is None:
                n, total, segments, last = n + row["n"], total + row["tf"][0], segments + 1, b""
                assert not row["ids"]
                continue
            assert last < row["token"].encode() and row["n"] == len(row["ids"])
            last = row["token"].encode()
            for i, tf, dl, at in zip(row["ids"], row["tf"], row["dl"], row["positions"]):
                assert tf == len(at) and (row["token"], i, dl) not in got
                got[row["token"], i, dl] = at
    assert got == want and (n, total) == (50, sum(len(t) for _, t in docs)) and segments > 10


def test_many_near_terms_are_joined(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(DOCS)], "external_id string, text string")
    c = Collection(docs, {"text": "text"})
    postings.build(c, "text", str(tmp_path / "p"))
    index = postings.Postings(spark, str(tmp_path / "p"))
    assert index.corpus == (6, 15)
    want = {h.external_id: h.score for h in c.search_all({"query": {"fuzzy": {"field": "text", "value": "red", "max_edits": 1}}}).collect()}
    for most in (0, 1000):
        monkeypatch.setattr(postings, "MOST_TERMS", most)
        got = {h.external_id: h.score for h in index.hits([("red", 1)], every=False).collect()}
        assert set(got) == {"0", "6"} and got == pytest.approx(want)
    assert postings.search(spark, str(tmp_path / "p"), N.Match("text", "...", "or")).collect() == []
