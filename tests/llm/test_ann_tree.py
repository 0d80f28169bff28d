import tracemalloc

import numpy as np
import pyarrow as pa
from plumbline.llm import ann_tree


def exact(rows, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k]
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 3000)] + 0.6 * r.normal(size=(3000, 16))
    x *= r.uniform(0.5, 2, (3000, 1))
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    rows += [(3000 + i, rows[40][1]) for i in range(200)]  # copies of a query
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [None] * 16), (4080, [float("inf")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for q, n, i, s in ann_tree.ann_query(df).collect():
        got.setdefault(q, []).append((n, -s, i))
    want = exact(rows)
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, 21))
        assert [x[1:] for x in g] == sorted(x[1:] for x in g)
        hit += len({i for _, i in w} & {x[2] for x in g})
    assert hit / (20 * len(want)) >= 0.9
    assert [x[2] for x in sorted(got[40])] == [i for _, i in want[40]]


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann_tree.ann_query(df).collect())
    assert got == [(0, 1, 20, 5.0), (0, 2, 1, 4.0), (20, 1, 0, 5.0), (20, 2, 1, 4.0)]
    assert ann_tree.ann_query(df.where("vec_id < 0")).collect() == []


def test_each_length_is_searched_apart(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0, 3.0]), (21, [3.0, 2.0, 1.0]), (22, [1.0, 1.0, 1.0]), (40, [4.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        got = sorted(tuple(r) for r in ann_tree.ann_query(df).collect())
        assert got == [(0, 1, 1, 4.0), (20, 1, 21, 10.0), (20, 2, 22, 6.0)]


def test_driver_holds_a_bounded_sample_of_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "SAMPLE_BYTES", 2_000_000, raising=False)
    sizes, fit = [], ann_tree.Tree
    monkeypatch.setattr(ann_tree, "Tree", lambda x, n: sizes.append(x.shape) or fit(x, n))
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 512))
    x = (centres[r.integers(0, 40, 3000)] + 0.3 * r.normal(size=(3000, 512))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(3000)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    tracemalloc.start()
    try:
        out = ann_tree.ann_query(df)
        assert tracemalloc.get_traced_memory()[1] < 16_000_000
    finally:
        tracemalloc.stop()
    assert sizes == [(488, 513)]
    got = {}
    for q, _, i, _ in out.collect():
        got.setdefault(q, set()).add(i)
    y = x.astype(float)
    hit = 0
    for q in range(0, 3000, 20):
        score = y @ y[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20].tolist()) & got[q])
    assert hit / (20 * 150) >= 0.9


def _clusters(n, dim=8, seed=9):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(60, dim))
    return (centres[r.integers(0, 60, n)] + 0.4 * r.normal(size=(n, dim))).astype(np.float32)


def test_what_python_makes_is_never_broadcast(spark):
    """Spark takes the rows that come out of Python for as many as go in, and would broadcast the routed queries."""
    x = _clusters(2000)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(2000)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    plan = ann_tree.ann_query(df)._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in plan]
    for i, line in enumerate(plan):
        if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line:
            sides = [j for j in range(i + 1, len(plan)) if depth[j] == depth[i] + 3]
            end = next((j for j in range(sides[1], len(plan)) if depth[j] <= depth[i]), len(plan))
            small = plan[sides[1] : end] if "BuildRight" in line else plan[sides[0] : sides[1]]
            assert not any("MapInArrow" in s for s in small), line
    assert any("MapInArrow" in line for line in plan) and any("SortMergeJoin" in line for line in plan)


def test_a_query_is_sent_once_to_each_group(spark):
    x = _clusters(4000).astype(float)
    tree = ann_tree.Tree(np.c_[x, np.zeros(len(x))], 400)
    groups = ann_tree.Groups(np.bincount(tree.assign(np.c_[x, np.zeros(len(x))]), minlength=tree.n_leaves))
    assert tree.n_leaves > 4 * ann_tree.GROUPS
    ids = pa.array(np.arange(200))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(list(x[:200].astype(np.float32)), pa.list_(pa.float32()))], ["cid", "vec"])
    for visits in (1, 30, tree.n_leaves):
        seen = {}
        for b in ann_tree._route(tree, groups, visits, 8)([batch]):
            for g, qi, qm, bits in zip(*(b.column(n).to_pylist() for n in ("g", "qi", "qm", "bits"))):
                assert len(qm) == 8 * len(qi) and len(qi) <= ann_tree.PACK
                rows = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(qi), -1), axis=1)
                for q, row in zip(qi, rows):
                    assert (q, g) not in seen and row.any()
                    seen[q, g] = row.sum()
        for q in range(200):
            assert sum(n for (i, _), n in seen.items() if i == q) == visits
        assert len(seen) <= 200 * ann_tree.GROUPS


def test_visits_come_best_bin_first():
    x = _clusters(3000).astype(float)
    tree = ann_tree.Tree(x, 200)
    for q, got in zip(x[:20], tree.best_bins(x[:20], tree.n_leaves)):
        queue, far, turn = [(0.0, 0)], -1.0, []
        while queue:  # the walk itself: leaves, each with the farthest centre that has come up by then
            d, node = queue.pop(queue.index(min(queue)))
            far = max(far, d)
            queue += [(float(((tree.centres[c] - q) ** 2).sum()), c) for c in tree.children[node]]
            turn += [] if tree.children[node] else [(round(far, 9), tree.leaf[node])]
        assert sorted(got.tolist()) == list(range(tree.n_leaves))
        at = dict((leaf, f) for f, leaf in turn)
        assert [at[leaf] for leaf in got.tolist()] == [f for f, _ in turn]
