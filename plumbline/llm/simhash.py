"""SimHash near-duplicates found through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most four bits share at least four of the
eight bytes at their positions. The index therefore posts every distinct fingerprint under 20 triples of positions,
chosen so that any four positions contain one of them (a Turan system); fingerprints under one key are paired, the
positional bytes that a pair shares are tallied, pairs below four are dropped and the rest are verified by their
Hamming distance. Links become components by distributed stars.

Equal fingerprints are one class, so copies, however many, never meet in pairs. A key with more than `MOST`
distinct fingerprints is not paired at all: its members go through an exact detour that is linear in their number
(two fingerprints within four bits, equal in three bytes, share a midpoint within two bits of both; each is posted
under the 821 midpoints of its 40 free bits). Inside a smaller key only a spanning forest is emitted.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a null doc_id takes part but
never names a component unless all ids there are null; repeated rows share a class; empty tables give empty
results; other columns pass through untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

P = "__s_"
#: Distinct fingerprints under one key that are compared with each other; larger keys take the exact detour.
MOST = 2048
MOST_BITS, LEAST_BYTES = 4, 4


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of byte positions of which every four positions contain one."""
    a, b, c = (0, 1, 2), (3, 4, 5), (6, 7)
    out = [a, b]
    for x, y in ((a, b), (b, c), (c, a)):
        out += [(*p, q) for p in itertools.combinations(x, 2) for q in y]
    return [tuple(sorted(t)) for t in out]


TRIPLES = position_triples()


def fingerprint(text: str | None, n_words: int = 4, seed: int = 42) -> int:
    """SimHash of the text's word shingles, repeats included, as an unsigned 64-bit number."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < n_words:
        h = [xxhash.xxh64_digest(b" ".join(w), seed)]
    else:
        joined = b" ".join(w)
        at = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts, ends = [0, *at[: len(w) - n_words].tolist()], (at[n_words - 1 :] - 1).tolist()
        h = map(xxhash.xxh64_digest, [joined[s:e] for s, e in zip(starts, ends)], itertools.repeat(seed))
    return majority(np.frombuffer(b"".join(h), np.uint8).reshape(-1, 8))


def majority(raw: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes, given as rows of eight bytes, most significant first."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 1 << 14):  # long texts: a megabyte of bits at a time
        ones += np.add.reduce(np.unpackbits(raw[k : k + (1 << 14)], axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def _add_fingerprints(text_at: int, drop_text: bool, n_words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), n_words, seed) for t in b.column(text_at)], np.uint64)
            arrays = [c for i, c in enumerate(b.columns) if not (drop_text and i == text_at)]
            names = [n for i, n in enumerate(b.schema.names) if not (drop_text and i == text_at)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(fps.view(np.int64))], [*names, P + "fp"])

    return run


def add_fingerprints(docs: DataFrame, text: str = "text", drop_text: bool = False, n_words: int = 4, seed: int = 42) -> DataFrame:
    """docs with the signed 64-bit pattern of each text's fingerprint in `__s_fp`."""
    at = docs.columns.index(text)
    names = [n for i, n in enumerate(docs.columns) if not (drop_text and i == at)]
    plain = docs.toDF(*[f"{P}c{i}" for i in range(len(docs.columns))])  # names with dots do not reach mapInArrow
    fields = [f for i, f in enumerate(plain.schema.fields) if not (drop_text and i == at)]
    made = plain.mapInArrow(_add_fingerprints(at, drop_text, n_words, seed), T.StructType([*fields, T.StructField(P + "fp", T.LongType())]))
    return made.toDF(*names, P + "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes are zero in each xor."""
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among the distinct fingerprints of one key."""
    n = len(fp)
    near = np.zeros((n, n), bool)
    for k in range(0, n, 256):
        x = fp[k : k + 256, None] ^ fp[None, :]
        i, j = np.nonzero(_popcount(x) <= MOST_BITS)
        ok = _shared_bytes(np.ascontiguousarray(x[i, j])) >= LEAST_BYTES
        near[k + i[ok], j[ok]] = True
    label = np.arange(n)
    while True:
        least = label.copy()
        for k in range(0, n, 256):
            least[k : k + 256] = np.where(near[k : k + 256], label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    # A label is reached over links, so linking to it adds no reachability that is not there.
    own = np.nonzero(label != np.arange(n))[0]
    return fp[own], fp[label[own]]


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("key", T.LongType())])
_ARROW_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key. Gives links (a, b, null) and members of keys above MOST as (fp, null, key)."""

    def rows(a, b, key):
        empty = lambda: pa.nulls(len(a), pa.int64())
        col = lambda x: empty() if x is None else pa.array(np.asarray(x).view(np.int64))
        return pa.RecordBatch.from_arrays([col(a), col(b), col(key)], schema=_ARROW_EDGES)

    kept_k, kept_f, spilling = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            k = np.concatenate([kept_k, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([kept_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        else:
            k, f = kept_k, kept_f
        if not len(k):
            continue
        if spilling is not None:
            own = k == spilling
            if own.any():
                yield rows(f[own], None, k[own])
                k, f = k[~own], f[~own]
                if not len(k):
                    kept_k, kept_f = k, f
                    continue
            spilling = None
        last = int(np.searchsorted(k, k[-1])) if b is not None else len(k)
        kept_k, kept_f = k[last:], f[last:]
        if len(kept_k) > MOST:
            spilling = kept_k[0]
            yield rows(kept_f, None, kept_k)
            kept_k, kept_f = kept_k[:0], kept_f[:0]
        k, f = k[:last], f[:last]
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
        size = np.diff(np.r_[edge, len(k)])
        for i in np.flatnonzero(size > 32):
            own = slice(edge[i], edge[i] + size[i])
            if size[i] > MOST:
                yield rows(f[own], None, k[own])
            else:
                x, y = _forest(f[own])
                yield rows(x, y, None)
        small = np.repeat((size <= 32) & (size > 1), size)
        k, f = k[small], f[small]
        for d in range(1, 32):
            i = np.flatnonzero(k[d:] == k[:-d])
            if not len(i):
                break
            x = f[i] ^ f[i + d]
            ok = _shared_bytes(x) >= LEAST_BYTES
            i = i[ok][_popcount(x[ok]) <= MOST_BITS]
            if len(i):
                yield rows(f[i], f[i + d], None)


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, key) to (key, midpoint, fp) for every way to flip up to two of the bits outside the key's three bytes."""
    masks = {}
    for b in batches:
        for fp, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t = key >> 24
            if t not in masks:
                bits = [1 << (8 * p + j) for p in range(8) if p not in TRIPLES[t] for j in range(8)]
                masks[t] = np.array([0, *bits, *[x | y for x, y in itertools.combinations(bits, 2)]], np.uint64)
            mid = (np.uint64(fp & (2**64 - 1)) ^ masks[t]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mid), key)), pa.array(mid), pa.array(np.full(len(mid), fp))], ["key", "mid", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within four bits of each other; fps has distinct values `fp`."""
    byte = lambda p: F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
    key = lambda i, t: F.lit(i << 24) + byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2])
    posted = fps.select(F.explode(F.array(*[key(i, t) for i, t in enumerate(TRIPLES)])).alias("key"), "fp")
    n = common.n_partitions(fps.sparkSession)
    found = posted.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_pair_up, _EDGES)
    found = common.materialize(found, "pairs")
    plain = found.where(F.col("key").isNull()).select("a", "b").distinct()
    large = found.where(F.col("key").isNotNull()).select(F.col("a").alias("fp"), "key")
    if large.isEmpty():
        return plain
    ball = large.mapInArrow(_midpoints, "key long, mid long, fp long")
    met = ball.groupBy("key", "mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 821 at most
    far = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where(F.col("a") != F.col("b")).select("a", "b")
    return plain.unionByName(far).distinct()


def label(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows with `__s_fp`, and in `__s_component` the smallest doc_id reachable over links."""
    classes = common.materialize(marked.groupBy(P + "fp").agg(F.min(doc_id).alias("rep")).withColumnRenamed(P + "fp", "fp"), "classes")
    roots = graph.components(links(classes.select("fp")))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    linked = named.join(least, "root").select("fp", "least")
    linked = classes.join(linked, "fp", "left").select(F.col("fp").alias(P + "fp"), F.coalesce("least", "rep").alias(P + "component"))
    return marked.join(linked, P + "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_text: bool = True) -> DataFrame:
    """docs with `__s_fp` and `__s_component`."""
    return label(common.materialize(add_fingerprints(docs, text, drop_text), "fingerprints"), doc_id)


def simhash_query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(P + "fp"), 16, "0")).alias("fingerprint"), F.col(P + "component").alias("component_id"))
