import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from plumbline.llm import suffix_array, suffix_dedup


def brute(rows, window=200):
    seen = {}
    for _, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - window + 1):
            seen[raw[i : i + window]] = seen.get(raw[i : i + window], 0) + 1
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - window + 1):
            if seen[raw[i : i + window]] > 1:
                gone[i : i + window] = True
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        n = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((d, len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    vocab = ["palabra", "für", "the", "of", "naïve", "日本", "x", "and", "longerword"]
    text = lambda n: " ".join(r.choice(vocab) + str(r.randrange(1000)) for _ in range(n))
    shared = [text(k) for k in (20, 30, 40, 60)]
    line = text(22)
    out = [None, "", "short", "ab" * 300, "é" * 400, "z" * 199, "y" * 200, "y" * 200]
    for _ in range(60):
        t = text(r.choice([5, 40, 120]))
        for _ in range(r.choice([0, 0, 1, 2])):
            s = r.choice(shared)
            if r.random() < 0.4:
                a = r.randrange(60)
                s = s[a : a + r.choice([150, 198, 230, 400])]
            t = t[: len(t) // 2] + s + t[len(t) // 2 :]
        out.append(t + line + text(3))
    out += [out[-1], out[-1], out[20]]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("hot", [500_000, 900])
def test_against_brute_force(spark, monkeypatch, hot):
    """Also with strings taken for hot so soon that windows are split at every length."""
    rows = corpus()
    levels = []
    if hot == 900:
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)  # long texts in slices
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
        real = suffix_dedup._covered
        monkeypatch.setattr(suffix_dedup, "_covered", lambda units, level: levels.append(level) or real(units, level))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, uid int").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.suffix_query(docs).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 5000
    assert hot > 900 or levels == [0, 1, 2, 3]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("plumbline")]


def test_shards_hold_whole_keys_and_are_bounded(monkeypatch):
    r = random.Random(4)
    base = "".join(chr(97 + r.randrange(26)) for _ in range(2000)).encode()
    rows = []
    for key in range(40):
        for _ in range(r.choice([1, 2, 9])):
            a = r.randrange(len(base) - 330)
            rows.append((key, base[a : a + r.randint(200, 330)]))
    rows = [(k, b, i.to_bytes(2, "big")) for i, (k, b) in enumerate(dict.fromkeys(rows))]
    weight = [1 + (i % 11 == 0) for i in range(len(rows))]
    sizes = []
    real = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda d, *a: sizes.append(len(d)) or real(d, *a))
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    table = pa.table([[x[0] for x in rows], [x[2] for x in rows], pa.array([len(x[1]) - 199 for x in rows], pa.int32()), weight, pa.array([x[1] for x in rows], pa.binary())], ["key", "sid", "n", "weight", "bytes"])
    for step in (7, 500):
        sizes.clear()
        out = [x for b in suffix_dedup._shards(iter(table.to_batches(step))) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert sum(sizes) == sum(len(x[1]) for x in rows) and max(sizes) < 3000 + 9 * 330 and len(sizes) > 5
        found = {(s, i) for s, a, e in out for i in range(a, e + 1)}
        places = {}
        for k, b, s in rows:
            for i in range(len(b) - 199):
                places.setdefault(b[i : i + 200], []).append((k, s, i))
        need = {(s, i) for v in places.values() for k, s, i in v if sum(x[0] == k for x in v) > 1} | {(s, i) for (k, b, s), w in zip(rows, weight) if w > 1 for i in range(len(b) - 199)}
        # Shards hold more keys than one, so windows of other keys may be found too, and are rightly repeated.
        assert need <= found <= need | {(s, i) for v in places.values() if len(v) > 1 for _, s, i in v}


def test_induced_sorting_and_prefixes():
    r = np.random.default_rng(0)
    for trial in range(200):
        k = int(r.choice([3, 5, 40]))
        t = np.r_[r.integers(1, k, r.integers(0, 60)), 0].astype(np.int32)
        if trial % 3 == 0:
            t = np.r_[t[:-1], t[:-1], t].astype(np.int32)
            t[: -1][t[:-1] == 0] = 1
        sa = suffix_array.suffix_array(t, k)
        li = t.tolist()
        want = sorted(range(len(li)), key=lambda i: li[i:])
        assert sa.tolist() == want
        got = suffix_array.common_prefixes(t, sa, 1)
        for a, b in zip(want, want[1:]):
            d = 0
            while max(a, b) + d < len(li) and li[a + d] == li[b + d] != 1:
                d += 1
            assert got[b] == d


def test_names_are_sorted_by_recursion_however_many(monkeypatch):
    r = random.Random(6)
    words = ["".join(chr(97 + r.randrange(26)) for _ in range(r.randint(2, 9))) for _ in range(3000)]
    raw = " ".join(r.choice(words) for _ in range(25_000)).encode()
    t = np.append(np.frombuffer(raw, np.uint8).astype(np.int32) + 2, 0)
    calls = []
    real = suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda t, k: calls.append((len(t), k)) or real(t, k))
    sa = suffix_array.suffix_array(t, 258)
    assert len(calls) >= 3 and calls[1][1] > 5000
    assert np.array_equal(np.sort(sa), np.arange(len(t)))
    some = range(0, len(sa) - 1, 7)
    assert all(raw[sa[i] : sa[i] + 400] < raw[sa[i + 1] : sa[i + 1] + 400] or raw[sa[i] :] < raw[sa[i + 1] :] for i in some)


def test_documents_keep_columns_and_characters(spark):
    p = "".join(chr(0x3B1 + i % 20) + str(i) for i in range(120))
    rows = [(1, "ä" + p + " tail one here", 5), (2, "ö" + p + "ü second tail", 5), (3, p, 5), (4, p, 6), (5, None, 0), (6, " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r[0]: tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert sorted(got) == [1, 2, 5, 6]
    assert got[1] == (1, "ä tail one here", 15)
    assert got[2][1] == "öü second tail"
    assert got[5] == (5, None, 0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert suffix_dedup.suffix_query(docs).collect() == []
    assert suffix_dedup.remove_repeats(docs).collect() == []
