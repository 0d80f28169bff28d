import itertools
import random

import xxhash
from plumbline.llm import near_copies, simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(fps):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(fps))


def corpus(n=120):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(200)] + ["Été", "ẞ", "İx"]
    base = [" ".join(r.choices(vocab, k=r.choice([1, 2, 3, 4, 30, 80, 300]))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(r.choice([0, 0, 1, 3])):
            w = t.split(" ")
            w[r.randrange(len(w))] = r.choice(vocab)
            out.append(r.choice([" ", "\n", "\t\x0b "]).join(w).upper() if r.random() < 0.2 else " ".join(w))
    out += ["", " \n\t", None, base[0], base[0]]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def test_every_four_positions_hold_a_triple():
    assert len(set(simhash.TRIPLES)) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.TRIPLES)


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, key string")
    got = sorted(tuple(r) for r in simhash.simhash_query(docs).collect())
    assert got == slow_components(rows)


def test_large_keys_take_the_exact_detour(spark, monkeypatch):
    r = random.Random(1)
    fps = {r.getrandbits(64)}
    for _ in range(60):  # a chain of small steps
        x = r.choice(sorted(fps))
        for _ in range(r.choice([1, 2, 4, 5])):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def roots():
        from plumbline.llm import graph

        return sorted(tuple(x) for x in graph.components(simhash.links(df)).collect())

    plain = roots()
    import numpy as np

    f = np.array(sorted(fps), np.uint64)
    batches = []
    import pyarrow as pa

    keys = sorted((i << 24 | (x >> 8 * t[0] & 255) << 16 | (x >> 8 * t[1] & 255) << 8 | (x >> 8 * t[2] & 255), x) for i, t in enumerate(simhash.TRIPLES) for x in fps)
    for k in range(0, len(keys), 37):
        part = keys[k : k + 37]
        batches.append(pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array(np.array([p[1] for p in part], np.uint64).view(np.int64))], ["key", "fp"]))
    monkeypatch.setattr(simhash, "MOST", 3)
    out = pa.Table.from_batches(list(simhash._pair_up(iter(batches)))).to_pylist()
    over = [(x["a"], x["key"]) for x in out if x["key"] is not None]
    assert over
    pairs = {(x["a"], x["b"]) for x in out if x["key"] is None}
    met = {}
    for b in simhash._midpoints(iter([pa.RecordBatch.from_arrays([pa.array([o[0] for o in over]), pa.array([o[1] for o in over])], ["fp", "key"])])):
        for k, m, x in zip(*[c.to_pylist() for c in b.columns]):
            met.setdefault((k, m), []).append(x)
    for v in met.values():
        pairs |= {(x, min(v)) for x in v}
    from plumbline.llm import graph

    e = spark.createDataFrame(sorted(pairs), "a long, b long")
    assert sorted(tuple(x) for x in graph.components(e).collect()) == plain
    assert len(f) > 20


def test_one_row_of_each_group_stays(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t, None), (3, t, "a"), (3, t, "a"), (None, t, "b"), (9, "other text altogether, long enough to be on its own here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = near_copies.drop_near_duplicates(docs)
    assert got.columns == ["doc_id", "text", "root"]
    assert sorted((r[0], r[2]) for r in got.collect()) == [(3, "a"), (9, "c")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_query(docs).collect() == []
    assert near_copies.drop_near_duplicates(docs).collect() == []
