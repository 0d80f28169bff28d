import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import id_coder, id_files, tokens
from tokenizers import Tokenizer


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3000), st.sampled_from([1, 2, 7, 300, 50257]), st.integers(0, 2**31), st.booleans())
def test_a_block_comes_back(n, vocabulary, seed, skewed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, vocabulary, n)
    if skewed:
        x = (x * rng.random(n) ** 4).astype(np.int64)
    x = x.astype("<u4")
    assert (id_coder.decode(id_coder.encode(x, vocabulary)) == x).all()


def test_many_lanes_and_long_runs():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 50257, 3) for _ in range(200)]
    x = np.concatenate([words[i] for i in (200 * rng.random(60_000) ** 3).astype(int)]).astype("<u4")
    frame = id_coder.encode(x, 50257)
    assert (id_coder.decode(frame) == x).all()
    counts = np.bincount(x)
    p = counts[counts > 0] / len(x)
    assert 8 * len(frame) < 0.7 * len(x) * -(p * np.log2(p)).sum()  # contexts pay: well under the order-0 entropy
    same = np.full(300_000, 9, "<u4")
    assert len(id_coder.encode(same, 50257)) < 40_000 and (id_coder.decode(id_coder.encode(same, 50257)) == same).all()


def test_damage_is_found():
    frame = bytearray(id_coder.encode(np.arange(4000, dtype="<u4"), 50257))
    frame[len(frame) // 2] ^= 4
    with pytest.raises(id_coder.Damaged):
        id_coder.decode(bytes(frame))
    with pytest.raises(id_coder.Damaged):
        id_coder.decode(b"PLID")


def _expected(rows, end=2):
    enc = Tokenizer.from_file(tokens.default_vocabulary())
    out, at = [], 0
    for key, text in rows:
        raw = b"".join(i.to_bytes(4, "little") for i in enc.encode(text or "", add_special_tokens=False).ids) + end.to_bytes(4, "little")
        out.append((key, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    return out


def test_files_against_plain_encoding(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"Text {i}  with\n\nodd spaces und Wörter {i * i} " * (400 if i == 30 else 1 + i % 5)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, t) for i, t in rows[::-1]], "doc_id long, text string, frame string")
    id_files.write(docs, str(tmp_path / "ids"), block=500)
    back = id_files.read(spark, str(tmp_path / "ids"), with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back) == _expected(rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in back)


def test_repeats_nulls_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(5, "b b"), (None, "x"), (5, "b b"), (5, None), (1, "a")], "doc_id long, text string")
    got = id_files.ids_query(docs).collect()
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert [r[2] for r in spans] == [None, 1, 5, 5, 5]
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert id_files.ids_query(docs.limit(0)).count() == 0


def test_places_are_looked_up_in_order(monkeypatch):
    """Lookups in the frequency table dominate decoding unless neighbouring keys ascend."""
    r = np.random.default_rng(3)
    ids = np.minimum(r.geometric(0.002, 20_000) - 1, 4999).astype(np.uint32)
    frame, search, seen = id_coder.encode(ids, 5000), np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: seen.append(bool((np.diff(v) >= 0).all())) or search(a, v, *more))
    assert (id_coder.decode(frame) == ids).all()
    assert seen and all(seen)
