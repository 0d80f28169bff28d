"""The five stages, each held against a plain version of itself on what it was given."""

import duckdb
import pytest
from plumbline.llm import common, mixing, quality

import corpus_pipeline

from . import test_packing, test_suffix_dedup

SF = "/root/testdata/sf0.001"


def _sql(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(sql).fetchdf()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = common.materialize(stage(spark, docs, SF), name)
        out.append((docs, done))
        docs = done
    return out


def test_stages_return_the_columns_of_documents(spark, stages):
    columns = common.table(spark, SF, "documents").dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    assert all(done.dtypes == columns for _, done in stages[:-1])


def test_quality_stage(stages):
    before, after = stages[0]
    want = _sql(quality.QUALITY_SQL, before.toArrow())
    assert sorted(r.doc_id for r in after.collect()) == sorted(want[want.kept].doc_id)


def test_near_duplicate_stage(stages):
    """Against all pairs of five-word shingle sets of similarity 0.8 and more."""
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                old, new = label[i], label[j]
                label = [new if v == old else v for v in label]
    least = {}
    for (d, _), v in zip(rows, label):
        least[v] = min(d, least.get(v, d))
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())


def test_repeats_stage(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    removed = {d: n for d, _, n, _, _ in test_suffix_dedup.brute(rows)}
    texts = dict(rows)
    got = {r.doc_id: r.text for r in after.collect()}
    for d, n in removed.items():
        left = len((texts[d] or "").encode()) - n
        if d in got:
            # Characters are kept whole, so up to three bytes at either end of a span may stay.
            assert 0 <= len((got[d] or "").encode()) - left <= 8 * (n > 0) * 20
            assert n or got[d] == texts[d]
        else:
            assert n > 0


def test_mixing_stage(stages):
    before, after = stages[3]
    want = _sql(mixing.MIXING_SQL, before.toArrow())
    assert sorted(r.doc_id for r in after.collect()) == sorted(want.doc_id)


def test_packing_stage(stages):
    before, after = stages[4]
    rows = after.collect()
    assert sum(r.piece == 0 for r in rows) == before.count()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert len(places) <= test_packing.best_fit_decreasing([r.length for r in rows], 2048) * 1.01 + 1


def test_empty_and_odd_documents(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], columns)
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "x", 0), (2, "w " * 200, "en", "x", 400)], columns)
    for docs in (empty, odd):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialize(stage(spark, docs, SF), name)
            assert out.count() <= docs.count() * 2
            assert docs is not empty or out.count() == 0
