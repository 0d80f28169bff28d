"""Nearest neighbours by inner product over a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (`SAMPLE` vectors and `SAMPLE_BYTES`, which the driver never holds as rows), has at most `MAX_LEAVES` leaves and travels to the
executors in the task closure (at most 2 * MAX_LEAVES centres, whatever the table's size). Every vector is assigned
to a leaf. A query visits the leaves of the tree best bin first, nearest centre first, across branches; how many leaves it
visits is calibrated: for `CALIBRATION` queries the exact neighbours are found by one pass over all rows, and visits
are widened until the leaves visited hold `target` of them. Inner products become distances by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, so that the nearest centre means the largest product.

Equal vectors are one entry of the index with their k+1 smallest ids (more can't be asked for), so copies, however
many, cost one comparison. Neighbouring leaves make up `GROUPS` groups. A query goes once to each group it visits, with a bit for each
leaf there, not once to each leaf: what is shuffled grows with the table alone, however many leaves are visited. Entries and queries
are packed into chunks bounded in bytes before they are shuffled; chunks and packs of queries meet in a merge join on the
group (their sizes are unknown to Spark, which would broadcast them), scores are matrix products in double precision, and each task
keeps only the best of each query before anything is shuffled.

Defined cases: vectors that are null, all zero, or hold nulls or non-finite numbers take no part, nor do rows with a
null id; vectors of each length are searched among those of the same length, by a tree of their own; rows that repeat id and
vector count once; with fewer candidates than asked, all are returned; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
#: Of the sample's vectors in double precision; long vectors are fewer.
SAMPLE_BYTES = 40_000_000
MAX_LEAVES = 4096
LEAF = 128
BRANCH = 16
#: Parts of the tree that queries are sent to.
GROUPS = 24
#: Rows of a chunk of entries and of a pack of queries, and bytes of their vectors in double precision.
CHUNK, CHUNK_BYTES = 2048, 1 << 20
PACK, PACK_BYTES = 512, 1 << 19
#: Vectors held while they are dealt to chunks.
HELD_BYTES = 32_000_000
CALIBRATION = 128
#: Entries kept beyond the k asked for, before scores are taken anew; one is the query itself.
SPARE = 6


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - x @ (2 * c.T), axis=1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        full = n > 0
        c[full] = s[full] / n[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class Tree:
    """children[i]: node numbers below node i; leaves have none and carry a leaf number."""

    def __init__(self, x: np.ndarray, n_leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [x.mean(0)], [[]], [-1]
        todo = [(0, x, max(1, n_leaves))]
        while todo:
            node, own, quota = todo.pop()
            if quota < 2 or len(own) < 2:
                continue
            c = _kmeans(own, min(BRANCH, quota), 8, rng)
            near = np.argmin((c * c).sum(1)[None] - own @ (2 * c.T), axis=1)
            n = np.bincount(near, minlength=len(c))
            if (n > 0).sum() < 2:
                continue
            for j in np.flatnonzero(n):
                self.centres.append(c[j])
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, own[near == j], int(round(quota * n[j] / len(own)))))
        self.centres = np.array(self.centres)
        ends = [i for i, ch in enumerate(self.children) if not ch]
        for k, i in enumerate(ends):
            self.leaf[i] = k
        self.n_leaves = len(ends)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            ch = self.children[node]
            if not ch:
                out[own] = self.leaf[node]
                continue
            c = self.centres[ch]
            near = np.argmin((c * c).sum(1)[None] - 2 * x[own] @ c.T, axis=1)
            for j in range(len(ch)):
                sel = own[near == j]
                if len(sel):
                    todo.append((ch[j], sel))
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> np.ndarray:
        """The first leaves of each query's best-bin-first walk, a row a query. A leaf's turn comes when the farthest centre on its way
        from the root has come up, so the order is that of these farthest distances, then of the leaves' own."""
        far = (self.centres * self.centres).sum(1)[None] - 2 * q @ self.centres.T + (q * q).sum(1)[:, None]
        far[:, 0] = -np.inf
        ends = np.array([i for i, ch in enumerate(self.children) if not ch])  # in the order of the leaves' numbers
        own = far[:, ends].copy()
        for i, ch in enumerate(self.children):  # children stand behind their parents
            if ch:
                far[:, ch] = np.maximum(far[:, ch], far[:, i : i + 1])
        return np.lexsort((own, far[:, ends]), axis=-1)[:, :visits].astype(np.int32)


class Groups:
    """Runs of neighbouring leaves that hold about as many vectors of the sample each: those of group g are first[g] to first[g + 1] - 1."""

    def __init__(self, counts: np.ndarray):
        before = np.cumsum(counts) - counts
        self.of = np.minimum(GROUPS - 1, before * GROUPS // max(1, int(counts.sum()))).astype(np.int32)
        self.first = np.searchsorted(self.of, np.arange(GROUPS + 1))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))]


def _first(df: DataFrame, n: int, of: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(cid, vectors) of the n rows (cid, vec) with the smallest hashes of their ids, out of `of` rows."""
    # Ids are distinct, so a filter on their hash keeps about so many in all, and little more reaches the driver.
    some = df.where(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(of)) < 2 * n) if of > 2 * n else df
    got = some.select("cid", "vec", F.xxhash64("cid").alias("h")).toArrow()
    cid = got.column("cid").to_numpy()
    at = pa.array(np.lexsort((cid, got.column("h").to_numpy()))[:n])
    out = cid[at], _matrix(got.column("vec").take(at).combine_chunks(), dim)
    del got
    pa.default_memory_pool().release_unused()
    return out


def _top(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k best of each row that reach its floor, ties at the last place included."""
    some = scores >= np.maximum(floor, np.finfo(float).min)[:, None]
    if scores.shape[1] > k and some.sum() > 2 * k * len(scores):
        some &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    return np.nonzero(some)


_BEST = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])


class _Best:
    """The k best hits of each of a bounded set of queries so far, by score and then smaller id."""

    def __init__(self, k: int, qids: np.ndarray):
        self.k, self.qids, self.parts, self.size = k, np.sort(qids), [], 0
        self.least = np.full(len(qids), -np.inf)

    def floor(self, qids: np.ndarray) -> np.ndarray:
        """A score that k hits of each query are known to reach."""
        return self.least[np.searchsorted(self.qids, qids)]

    def add(self, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.parts.append(hits)
        self.size += len(hits[0])
        if self.size > 2 * self.k * len(self.qids):
            self.reduce()

    def reduce(self) -> None:
        if self.parts:
            q, c, s = (np.concatenate(x) for x in zip(*self.parts))
            o = np.lexsort((c, -s, q))
            q, c, s = q[o], c[o], s[o]
            edge = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.repeat(edge, np.diff(np.r_[edge, len(q)]))
            last = rank == self.k - 1
            self.least[np.searchsorted(self.qids, q[last])] = s[last]
            own = rank < self.k
            self.parts, self.size = [(q[own], c[own], s[own])], int(own.sum())

    def batch(self) -> pa.RecordBatch:
        self.reduce()
        cols = self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_BEST)


def _cells(b: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The arrays of each row of list columns."""
    cols = [b.column(n) for n in names]
    cols = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in cols]
    for i in range(len(b)):
        yield [v[o[i] : o[i + 1]] for o, v in cols]


def _exact(qids: np.ndarray, q: np.ndarray, k: int):
    """All chunks against a bounded set of queries: the best of each query per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, qids)
        for b in batches:
            for ids, xm in _cells(b, ("ids", "xm")):
                scores = q @ xm.astype(np.float64).reshape(-1, q.shape[1]).T
                i, j = _top(scores, k, best.floor(qids))
                best.add((qids[i], ids[j], scores[i, j]))
        yield best.batch()

    return run


def _visited(q: np.ndarray, x: np.ndarray, leaf: np.ndarray, visits: np.ndarray) -> np.ndarray:
    """Products of queries and entries where the query visits the entry's leaf (a number in the group), else -inf."""
    want = visits[:, leaf]
    if want.mean() > 0.25:
        return np.where(want, q @ x.T, -np.inf)
    out = np.full(want.shape, -np.inf)
    edge = np.r_[np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), len(leaf)]
    for a, e in zip(edge[:-1], edge[1:]):
        own = np.flatnonzero(want[:, a])
        if len(own):
            out[own, a:e] = q[own] @ x[a:e].T
    return out


def _in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the order of the components, as scores are defined."""
    out = np.zeros(len(q))
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)):
        out += a * b
    return out


def _score_chunks(groups: Groups, dim: int, k: int):
    """Rows (group, pack of queries, chunk of entries) to the best hits of each pack. Products of matrices round by the matrices' shape,
    so those kept (a few more than asked for) are added anew. Rows of a pack come one behind the other, so that one pack is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = held = None
        for b in batches:
            for g, bits, (qi, qm, ids, leaf, xm) in zip(b.column("g").to_pylist(), b.column("bits").to_pylist(), _cells(b, ("qi", "qm", "ids", "leaf", "xm"))):
                if held != (g, qi[0], len(qi)):
                    if best is not None:
                        yield best.batch()
                    held, best = (g, qi[0], len(qi)), _Best(k, qi)
                    q = qm.astype(np.float64).reshape(-1, dim)
                    visits = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(qi), -1), axis=1).astype(bool)
                x = xm.astype(np.float64).reshape(-1, dim)
                i, j = _top(_visited(q, x, leaf - groups.first[g], visits), k, best.floor(qi))
                for a in range(0, len(i), 1 << 14):
                    own, its = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                    best.add((qi[own], ids[its], _in_order(q[own], x[its])))
        if best is not None:
            yield best.batch()

    return run


def _pieces(ends: list[int], ids: np.ndarray, vec: pa.Array, dim: int) -> list[pa.Array]:
    """Two list columns, ids and matrices, of rows cut at `ends` (from 0)."""
    ends = np.asarray(ends, np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.ListArray.from_arrays(pa.array(ends * np.int32(dim)), vec.flatten())]


def _deal(tree: Tree, groups: Groups, top: float, dim: int):
    """Rows (cid, vec) to chunks (g, ids, leaf, xm) in the order of leaves, each of one group."""
    most = max(16, min(CHUNK, CHUNK_BYTES // (8 * dim)))

    def chunks(held: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        leaf = np.concatenate([h[2] for h in held])
        o = np.argsort(leaf, kind="stable")
        leaf, ids, vec = leaf[o], np.concatenate([h[0] for h in held])[o], pa.concat_arrays([h[1] for h in held]).take(pa.array(o))
        at = np.searchsorted(leaf, groups.first)
        ends = [0]
        for a, e in zip(at[:-1], at[1:]):
            ends += [*range(a + most, e, most), e] if e > a else []
        qi, qm = _pieces(ends, ids, vec, dim)
        return pa.RecordBatch.from_arrays([pa.array(groups.of[leaf[ends[:-1]]]), qi, pa.ListArray.from_arrays(qi.offsets, pa.array(leaf)), qm], ["g", "ids", "leaf", "xm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if len(b):
                held.append((b.column(0).to_numpy(), b.column(1), tree.assign(_lift(_matrix(b.column(1), dim), top))))
                size += 8 * dim * len(b)
                if size > HELD_BYTES:
                    yield chunks(held)
                    held, size = [], 0
        if held:
            yield chunks(held)

    return run


def _route(tree: Tree, groups: Groups, visits: int, dim: int):
    """Queries to packs (g, qi, qm, bits): ids, matrix, and a row of bits for each query that tell which leaves of the group it visits."""
    some = max(1, 2_000_000 // len(tree.centres))
    most = max(16, min(PACK, PACK_BYTES // (8 * dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), some):
                part = b.slice(s, some)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                bins = tree.best_bins(np.c_[q, np.zeros(len(q))], visits)
                seen = np.zeros((len(q), tree.n_leaves), bool)
                np.put_along_axis(seen, bins, True, axis=1)
                order = np.argsort(bins[:, 0], kind="stable")  # queries of a pack have leaves in common
                for g, (lo, hi) in enumerate(zip(groups.first[:-1], groups.first[1:])):
                    own = order[seen[order, lo:hi].any(axis=1)]
                    if len(own):
                        ends = [0, *range(most, len(own), most), len(own)]
                        bits = [np.packbits(seen[own[a:e], lo:hi], axis=1).tobytes() for a, e in zip(ends[:-1], ends[1:])]
                        pieces = _pieces(ends, ids[own], part.column(1).take(pa.array(own)), dim)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), g, np.int32)), *pieces, pa.array(bits, pa.binary())], ["g", "qi", "qm", "bits"])

    return run


def index_entries(table: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct usable vectors: ekey, cid (smallest id), vec, ids (the k+1 smallest)."""
    v = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec"))
    number = lambda x: x.cast("double")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    v = v.where(~bad & F.exists("vec", lambda x: number(x) != 0)).withColumn("ekey", F.unhex(F.md5(F.col("vec").cast("string"))))
    few = v.select("ekey", "vec_id").distinct()
    few = few.withColumn("rn", F.row_number().over(Window.partitionBy("ekey").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    few = few.groupBy("ekey").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = v.groupBy("ekey").agg(F.first("vec").alias("vec"))
    return one.join(few, "ekey").select("ekey", F.get("ids", F.lit(0)).alias("cid"), "vec", "ids")


def search(table: DataFrame, k: int = 20, queries=None, target: float = 0.97, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all other rows.

    `queries` is a condition on the id column; by default ids divisible by 20."""
    spark = table.sparkSession
    ids = F.col(vec_id).cast("long")
    asked = (F.pmod(ids, F.lit(20)) == 0) if queries is None else queries
    entries = common.materialize(index_entries(table, k, vec_id, vector), "entries")
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = sorted(r["d"] for r in entries.select(F.size("vec").alias("d")).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = table.where(asked & ids.isNotNull()).select(ids.alias("query_id"), F.unhex(F.md5(F.col(vector).cast("string"))).alias("ekey")).distinct()
    found = [_search_length(entries.where(F.size("vec") == dim) if len(lengths) > 1 else entries, rows, dim, k, target) for dim in lengths]
    return functools.reduce(DataFrame.unionByName, found)


def _search_length(entries: DataFrame, rows: DataFrame, dim: int, k: int, target: float) -> DataFrame:
    """The search among entries of one length; rows are queries (query_id, ekey), those of other lengths are passed over."""
    rows = common.materialize(rows.join(entries.select("ekey", "cid"), "ekey").select("query_id", "cid"), "queries")
    q = common.materialize(entries.join(rows.select("cid").distinct(), "cid").select("cid", "vec"), "query_vectors")

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = entries.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    top = stats["top"]
    _, some = _first(entries, max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim))), stats["n"], dim)
    some = _lift(some, top)
    tree = Tree(some, max(1, min(MAX_LEAVES, stats["n"] // LEAF, len(some) // 2)))
    groups = Groups(np.bincount(tree.assign(some), minlength=tree.n_leaves))
    del some
    kind = entries.schema["vec"].dataType.simpleString()
    chunks = entries.select("cid", "vec").mapInArrow(_deal(tree, groups, top, dim), f"g int, ids array<long>, leaf array<int>, xm {kind}")
    chunks = common.materialize(chunks, "chunks")

    # Calibration: in which place of a query's walk are the leaves of its true neighbours?
    pid, pq = _first(q, CALIBRATION, q.count(), dim)
    best = chunks.select("ids", "xm").mapInArrow(_exact(pid, pq, k + 1), "qid long, cid long, score double")
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    best = best.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)  # CALIBRATION * (k + 1) rows
    leaf_of = chunks.select(F.explode(F.arrays_zip("ids", "leaf")).alias("e")).select(F.col("e.ids").alias("cid"), F.col("e.leaf").alias("leaf"))
    true = leaf_of.join(F.broadcast(best), "cid").select("qid", "leaf").collect()
    walks = tree.best_bins(np.c_[pq, np.zeros(len(pq))], tree.n_leaves)
    walk = {int(i): np.argsort(w) for i, w in zip(pid, walks)}
    depth = np.sort([walk[r["qid"]][r["leaf"]] for r in true])
    visits = int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))) - 1)]) + 1 if len(depth) else 1

    routed = q.mapInArrow(_route(tree, groups, visits, dim), f"g int, qi array<long>, qm {kind}, bits binary")
    # Neither side is one to broadcast, though Spark takes what comes out of Python for as small as what went in.
    met = routed.join(chunks.hint("merge"), "g").select("g", "bits", "qi", "qm", "ids", "leaf", "xm")
    found = met.mapInArrow(_score_chunks(groups, dim, k + SPARE), "qid long, cid long, score double")
    found = found.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + SPARE).select("qid", "cid", "score")
    named = found.join(entries.select("cid", "ids").hint("merge"), "cid")
    near = named.select("qid", "score", F.explode("ids").alias("id")).select("qid", F.struct((-F.col("score")).alias("s"), "id").alias("hit"))
    near = near.groupBy("qid").agg(F.sort_array(F.collect_list("hit")).alias("hits"))  # (k + SPARE)^2 at most
    out = rows.join(near.withColumnRenamed("qid", "cid"), "cid")
    mine = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(mine).alias("p", "hit"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def ann_query(table: DataFrame) -> DataFrame:
    return search(table.select("vec_id", "embedding"))
