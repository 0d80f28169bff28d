import random
import zlib

import numpy as np
from plumbline.llm import packing, tokens
from tokenizers import Tokenizer


def best_fit_decreasing(sizes, length):
    """Sequences that one-by-one best fit needs."""
    gaps, n = np.zeros(length + 1, np.int64), 0
    for s in sorted(sizes, reverse=True):
        fit = np.flatnonzero(gaps[s:])
        if len(fit):
            g = s + int(fit[0])
            gaps[g] -= 1
        else:
            g, n = length, n + 1
        gaps[g - s] += 1
    return n


def _check(placements, counts, length):
    """Every rank of every class once; no two pieces of a sequence overlap, and none leaves a gap before it."""
    seen, held = {k: np.zeros(n, int) for k, n in counts.items()}, {}
    for k, r0, n, s0, off in placements:
        seen[k][r0 : r0 + n] += 1
        for i in range(n):
            held.setdefault(s0 + i, []).append((off, k))
    assert all((v == 1).all() for v in seen.values())
    for parts in held.values():
        at = 0
        for off, k in sorted(parts):
            assert off == at
            at += k
        assert at <= length
    return len(held)


def test_sweeps_need_about_as_many_sequences_as_one_by_one():
    r = random.Random(2)
    for length, low, high, n in ((64, 1, 64, 500), (64, 20, 40, 300), (100, 1, 12, 2000), (2048, 50, 2048, 1500), (50, 50, 50, 30), (31, 11, 16, 400)):
        sizes = [r.randint(low, high) for _ in range(n)]
        counts = {k: sizes.count(k) for k in set(sizes)}
        placements, n_seq = packing.sweep(counts, length)
        assert _check(placements, counts, length) == n_seq
        assert n_seq <= 1.02 * best_fit_decreasing(sizes, length) + 1
    assert packing.sweep({}, 64) == ([], 0)


def test_pieces_against_plain_encoding(spark):
    r = random.Random(8)
    vocab = ["alpha", "Beta", "gamma,", "für", "日本", "  ", "x\n\ny"]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 5, 60, 900])))) for i in range(80)]
    rows += [(80, None), (81, ""), (81, ""), (None, "no id"), (82, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, length int, piece string").repartition(3)
    got = packing.pack(docs, with_ids=True).collect()
    enc = Tokenizer.from_file(tokens.default_vocabulary())
    want = []
    for i, t in rows:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(str, (tuple(g)[:5] for g in got))) == sorted(map(str, want))
    places = {}
    for g in got:
        assert zlib.crc32(g.ids) == g.ids_crc32
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in places.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert len(places) <= best_fit_decreasing([w[3] for w in want], 2048) + 1
    whole = {s.sequence_id: s for s in packing.sequences(packing.pack(docs, with_ids=True)).collect()}
    assert all(len(s.ids) == 4 * s.n_tokens <= 4 * 2048 for s in whole.values())


def test_empty_table(spark):
    assert packing.packing_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
