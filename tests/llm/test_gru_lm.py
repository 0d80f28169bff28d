import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from plumbline.llm import gru_lm as G


def vocabulary(c: Counter) -> G.Vocabulary:
    n, v = np.zeros(G.RARE), np.zeros(G.RARE)
    for w, k in c.items():
        n[G.rare_class(w)] += k
        v[G.rare_class(w)] += 1
    return G.Vocabulary(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: G.COMMON], sum(c.values()), len(c), n, v)


def corpus(n=240):
    r = random.Random(8)
    a, b = [f"alpha{i}" for i in range(40)], [f"beta{i}" for i in range(40)]
    out = []
    for i in range(n):
        v = a if i % 2 else b
        out.append((i, " ".join(r.choice(v) if r.random() < 0.95 else f"Rare{r.randrange(3000)}" for _ in range(r.choice([0, 3, 40, 200])))))
    return out


def test_gradients():
    r = np.random.default_rng(0)
    v = vocabulary(Counter({b"w%d" % i: 3000 - i for i in range(2500)}))
    flat = r.normal(0, 0.3, G.SIZE)
    docs = [r.choice([*range(50), 2100, G.COMMON + 3], size=n).astype(np.int32) for n in (5, 9, 3, 14)]
    codes, owner = G.lanes(docs, 2)

    def loss(f):
        net, h, total = G.Network(f, v), np.zeros((len(codes), G.HIDDEN)), 0.0
        for k, x, start, _ in net.windows(codes, owner, 100):
            s, h, _ = net.run(x, start, h[: k.shape[1]], False)
            total += net.log_probs(s.astype(np.float64), k)[0].sum()
        return total

    net, flat_g, h = G.Network(flat, v), np.zeros(G.SIZE), np.zeros((len(codes), G.HIDDEN))
    grads = G.unpack(flat_g)
    for k, x, start, _ in net.windows(codes, owner, 100):
        s, h, held = net.run(x, start, h, True)
        _, _, ds = net.log_probs(s, k, grads)
        net.backward(x, start, s, held, ds, grads)
    for i in r.choice(np.flatnonzero(np.abs(flat_g) > 1e-2), 15, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(flat_g[i], rel=2e-2, abs=2e-3)


def test_windows_and_lanes_do_not_change_scores():
    v = vocabulary(Counter({b"w%d" % i: 400 - i for i in range(300)} | {G.END: 50}))
    net = G.Network(G.first_weights(v) * 3, v)
    r = np.random.default_rng(1)
    docs = [r.integers(0, 300, n).astype(np.int32) for n in (1, 90, 33, 2, 70)]
    together = G.score(net, docs)
    assert np.allclose(together, [G.score(net, [d])[0] for d in docs], atol=1e-3)


def test_probabilities_sum_to_one():
    c = Counter({b"w%d" % i: 1 + 3000 // (i + 1) for i in range(3000)})
    v = vocabulary(c)
    net = G.Network(G.first_weights(v), v)
    s = np.random.default_rng(2).normal(0, 1, (1, 1, G.HIDDEN)).astype(np.float32)
    total = 0.0
    for w in c:
        k = v.codes[w]
        total += 10 ** (net.log_probs(s, np.array([[k]]))[0][0] / math.log(10) + v.in_rare[k])
    for b in range(G.RARE):  # what is unknown, class by class
        total += math.exp(net.log_probs(s, np.array([[G.COMMON + b]]))[0][0]) * 0.5 / v.rare_all[b]
    assert total == pytest.approx(1, abs=1e-3)


def test_query(spark, monkeypatch):
    rows = [*corpus(), (1000, None), (1001, " \n "), (None, "alpha1 beta2"), (1000, None)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    got = G.score_documents(df).collect()
    assert len(got) == len(rows)
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            c.update([*G.words(t), G.END])
    n, v = sum(c.values()), len(c)
    by = {}
    for r in got:
        by[r["doc_id"]] = r
    base, score = 0.0, 0.0
    for i, t in rows:
        r, w = by[i], [*G.words(t), G.END]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base  # the state knows which of the two languages it reads
    assert G.score_documents(df.limit(0)).collect() == []


def test_most_frequent_words_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(G, "COMMON", 50)
    rows = [(f"w{i:03}", 1 + 2000 // (i + 1)) for i in range(400)]
    got = G._most_frequent(spark.createDataFrame(rows, "word string, n long"))
    assert 30 < len(got) <= 50
    assert got == [(w.encode(), n) for w, n in rows[: len(got)]]
    assert G._most_frequent(spark.createDataFrame([(f"x{i}", 1) for i in range(60)], "word string, n long")) == []


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 997}" for i in range(120_000))
    df = spark.createDataFrame([(i, long if i == 3 else "w1 w2 w3") for i in range(12)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in G.score_documents(df).collect()}
    assert got[3]["n_tokens"] == 120_001 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
