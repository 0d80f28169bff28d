"""Log-likelihood of whole documents under a gated recurrent language model, in numpy.

The output is factored by classes: P(word) = P(class | state) * P(word | class, ...). The `NET` most frequent tokens
form classes of `PER_CLASS`, with a softmax over the class's members given the state. All other words fall into
`RARE` classes by their first two characters; the state predicts the class, corpus counts the word in it, with half
a count for each known word and for everything unknown. Every token thus has a probability, and they sum to one.

Learning covers every training document. Counts are exact sums over all of them. The recurrent weights start from a
short fit on `WARM_DOCS` documents (a bound that only sets where training starts), then every partition trains on
all of its documents by truncated backpropagation (`STEPS` steps, state carried over) and the weights are averaged
by the tokens each partition saw, as an aggregation over weight numbers: no partition's weights reach the driver on
their own, only the average does, whose size is fixed.

Scoring carries the state through each document from its first to its last token, in windows. Documents run side by
side in lanes. Counts of the `COMMON` most frequent tokens (a bound) travel in a broadcast; words beyond it are
joined with the count table on the word, which by construction has no very frequent key left.

Defined cases: a null text is an empty one, a single end token; a null id counts as the empty string when it is
dealt to training; rows that repeat an id are scored each for itself; with no training document at all, every token
is unknown; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

NET, PER_CLASS, RARE, COMMON = 2048, 64, 48, 65_536
HIDDEN, STEPS, LANES = 16, 32, 192
WARM_DOCS, WARM_TOKENS = 300, 4_000
END = b"\n"  # no word holds a line end
C = NET // PER_CLASS


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@functools.lru_cache(1 << 16)
def _class_of_head(head: bytes) -> int:
    return zlib.crc32(head.decode("utf-8", "replace")[:2].encode()) % RARE


def rare_class(word: bytes) -> int:
    head = word[:2]
    return _class_of_head(head if head.isascii() else word[:8])  # two characters are eight bytes at most


class Vocabulary:
    """What every worker knows: the common tokens with their counts, totals, and sums of the rare classes."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int, class_n: np.ndarray, class_v: np.ndarray):
        self.total, self.distinct = total, distinct
        #: 0..NET-1 the network's words, then other common ones; a word beyond them has COMMON + its rare class.
        self.codes = {w: i for i, (w, _) in enumerate(top)}
        counts = np.zeros(COMMON)
        counts[: len(top)] = [n for _, n in top]
        self.klass = np.zeros(COMMON + RARE, np.int64)  # class of each code
        self.klass[:NET] = np.arange(NET) // PER_CLASS
        if len(top) > NET:
            self.klass[NET : len(top)] = C + np.array([rare_class(w) for w, _ in top[NET:]])
        self.klass[COMMON:] = C + np.arange(RARE)
        self.klass8 = self.klass.astype(np.uint8)
        class_n, class_v = class_n.astype(float), class_v.astype(float)
        for w, n in top[:NET]:
            class_n[rare_class(w)] -= n
            class_v[rare_class(w)] -= 1
        self.rare_all = class_n + 0.5 * (class_v + 1)
        self.base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        self.in_rare = np.zeros(COMMON + RARE)  # log10 P(word | rare class); 0 where a join tells it
        own = np.arange(NET, max(NET, len(top)))
        self.in_rare[own] = np.log10((counts[own] + 0.5) / self.rare_all[self.klass[own] - C])
        self.known = counts > 0
        self.input = np.concatenate([np.arange(NET), NET + self.klass[NET:] - C])
        self.counts = counts
        self.used = min(len(top), NET)

    def encode(self, text: str | None, tail: list | None = None) -> np.ndarray:
        """The codes of a text's tokens; words beyond the common ones are appended to `tail` as one list."""
        w = words(text)
        w.append(END)
        codes = np.fromiter(map(self.codes.get, w, itertools.repeat(-1)), np.int32, len(w))
        at = np.flatnonzero(codes < 0)
        beyond = [w[i] for i in at.tolist()]
        codes[at] = [COMMON + rare_class(x) for x in beyond]
        if tail is not None:
            tail.append([x.decode("utf-8", "replace") for x in beyond])
        return codes


SHAPES = {"E": (NET + RARE + 1, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "Wc": (HIDDEN, C + RARE), "bc": (C + RARE,), "Ww": (C, HIDDEN, PER_CLASS), "bw": (C, PER_CLASS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def first_weights(v: Vocabulary, seed: int = 3) -> np.ndarray:
    """Small random weights; output biases are the log frequencies, so that training starts from the unigram model."""
    flat = np.random.default_rng(seed).normal(0, 0.08, SIZE).astype(np.float32)
    p = unpack(flat)
    for k in ("b", "Wc", "Ww"):
        p[k] *= 0 if k == "b" else 0.3
    n = v.counts[:NET] + 0.5
    n[v.used :] = 0  # places that no word has
    mass = np.concatenate([n.reshape(C, PER_CLASS).sum(1), v.rare_all]) + 1e-9
    p["bc"][:] = np.log(mass / mass.sum())
    p["bw"][:] = np.log(np.maximum(n, 1e-9)).reshape(C, PER_CLASS)
    p["bw"] -= p["bw"].max(1, keepdims=True)
    return flat


def lanes(docs: list[np.ndarray], n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt to lanes of about equal length: codes (lane, step), -1 where a lane has ended, and document numbers."""
    # No more lanes than the longest document leaves full: ended lanes make small, slow windows.
    n_lanes = max(1, min(n_lanes, len(docs), max(16, sum(map(len, docs)) // max(map(len, docs)))))
    heap = [(0, i) for i in range(n_lanes)]
    rows: list[list[int]] = [[] for _ in range(n_lanes)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, lane = heapq.heappop(heap)
        rows[lane].append(i)
        heapq.heappush(heap, (size + len(docs[i]), lane))
    longest = max(s for s, _ in heap)
    codes, owner = np.full((n_lanes, longest), -1, np.int32), np.zeros((n_lanes, longest), np.int32)
    for lane, own in enumerate(rows):
        at = 0
        for i in own:
            codes[lane, at : at + len(docs[i])] = docs[i]
            owner[lane, at : at + len(docs[i])] = i
            at += len(docs[i])
    order = np.argsort([-sum(len(docs[i]) for i in own) for own in rows], kind="stable")
    return codes[order], owner[order]


class Network:
    def __init__(self, flat: np.ndarray, v: Vocabulary):
        self.flat, self.p, self.v = flat, unpack(flat), v

    def windows(self, codes: np.ndarray, owner: np.ndarray, steps: int):
        """(codes, inputs, starts, owner) of each window, time first; lanes that have ended are left out."""
        length = (codes >= 0).sum(1)
        start = np.ones(codes.shape, bool)
        start[:, 1:] = owner[:, 1:] != owner[:, :-1]
        previous = np.full(codes.shape, NET + RARE, np.int64)
        previous[:, 1:] = self.v.input[np.maximum(codes[:, :-1], 0)]
        previous[start] = NET + RARE
        for t in range(0, codes.shape[1], steps):
            n = int((length > t).sum())
            yield codes[:n, t : t + steps].T, previous[:n, t : t + steps].T, start[:n, t : t + steps].T, owner[:n, t : t + steps].T

    def run(self, inputs: np.ndarray, start: np.ndarray, h: np.ndarray, keep: bool):
        """States of a window, the last one, and what backpropagation needs of it."""
        p, H = self.p, HIDDEN
        T, B = inputs.shape
        kind = self.flat.dtype
        # Gates are logistic functions, 1 / (1 + exp(-x)); the candidate's tanh is 2 / (1 + exp(-2x)) - 1.
        scale = np.full(3 * H, -1, kind)
        scale[2 * H :] = -2
        x = ((p["E"] + p["b"]) * scale)[inputs]
        u = p["U"] * scale
        states = np.empty((T, B, H), kind)
        held = [np.empty((T, B, H), kind) for _ in range(4)] if keep else []
        fresh = start.any(1)
        a, zr, n = np.empty((B, 3 * H), kind), np.empty((B, 2 * H), kind), np.empty((B, H), kind)
        for t in range(T):
            if fresh[t]:
                h = h * ~start[t][:, None]
            np.matmul(h, u, out=a)
            np.add(x[t, :, : 2 * H], a[:, : 2 * H], out=zr)
            np.minimum(zr, 80, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.divide(1, zr, out=zr)
            np.multiply(zr[:, H:], a[:, 2 * H :], out=n)
            n += x[t, :, 2 * H :]
            np.minimum(n, 80, out=n)
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            now = states[t]
            np.subtract(h, n, out=now)
            if keep:
                # What the gradients of z, n and r are multiplied by is made of these, for all steps at once.
                held[0][t], held[1][t], held[2][t], held[3][t] = h, zr[:, :H], zr[:, H:], a[:, 2 * H :]
            now *= zr[:, :H]
            now += n
            h = now
        return states, h, held

    @staticmethod
    def _sums(logits: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(exponentials, in place of the logits; their sums; what logits that may be large were lowered by)."""
        shift = None
        if not bounded:
            shift = logits.max(1)
            logits -= shift[:, None]
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], logits.dtype), shift

    # The state a token is predicted from has seen every token before it: inputs are shifted by one.
    def log_probs(self, states: np.ndarray, codes: np.ndarray, grads: dict | None = None):
        """log P(class | state) + log P(word | class, state) of each code (natural logs); optionally gradients."""
        p, v = self.p, self.v
        k = codes.ravel()
        live = np.flatnonzero(k >= 0)
        # States lie between -1 and 1, so column sums bound the logits; exp of less than 80 cannot overflow.
        bounded = max(float((np.abs(p["Wc"]).sum(0) + np.abs(p["bc"])).max()), float((np.abs(p["Ww"]).sum(1) + np.abs(p["bw"])).max())) < 80
        klass = v.klass8[k[live]]
        # Tokens are put in the order of their classes once; each class is then a slice.
        order = np.argsort(klass, kind="stable")
        live, klass = live[order], klass[order]
        k = k[live]
        # Beside the state stands a 1, whose weights are the biases.
        s = np.ones((len(k), HIDDEN + 1), states.dtype)
        s[:, :HIDDEN] = states.reshape(-1, HIDDEN)[live]
        lc = s @ np.vstack([p["Wc"], p["bc"]])
        ww = np.concatenate([p["Ww"], p["bw"][:, None]], axis=1)
        at = np.arange(len(k))
        picked = lc[at, klass]
        e, total, shift = self._sums(lc, bounded)
        out = picked - np.log(total) - (0 if shift is None else shift)
        ds = None
        if grads is not None:
            e *= (-1 / total)[:, None]
            e[at, klass] += 1
            g = s.T @ e
            grads["Wc"] += g[:HIDDEN]
            grads["bc"] += g[HIDDEN]
            ds = e @ p["Wc"].T
        edge = np.searchsorted(klass, np.arange(C + 1)).tolist()
        for c in range(C):
            a, b = edge[c], edge[c + 1]
            if a == b:
                continue
            so, j, i = s[a:b], k[a:b] - c * PER_CLASS, at[: b - a]
            lw = so @ ww[c]
            picked = lw[i, j]
            e, total, shift = self._sums(lw, bounded)
            out[a:b] += picked - np.log(total) - (0 if shift is None else shift)
            if grads is not None:
                e *= (-1 / total)[:, None]
                e[i, j] += 1
                g = so.T @ e
                grads["Ww"][c] += g[:HIDDEN]
                grads["bw"][c] += g[HIDDEN]
                ds[a:b] += e @ p["Ww"][c].T
        if grads is None:
            return out, live
        full = np.zeros((states.shape[0] * states.shape[1], HIDDEN), np.float32)
        full[live] = ds
        return out, live, full.reshape(states.shape)

    def backward(self, inputs, start, states, held, ds, grads) -> None:
        """Truncated backpropagation: gradients stop at the window's first state and at document starts."""
        p, H = self.p, HIDDEN
        T, B = inputs.shape
        h, z, r, an = held
        # states = n + z * (h - n); n is had back from the gate's other side where z is not one, else its factor is 0.
        open_ = 1 - z
        n = (states - z * h) / np.maximum(open_, 1e-6)
        np.clip(n, -1, 1, out=n)
        to_n = open_ * (1 - n * n)
        to_z = (h - n) * z * open_
        to_r = an * (-0.5 * r * (1 - r))  # an is held as it was scaled for the exponential
        da = np.empty((T, B, 3 * H), states.dtype)
        dn = np.empty((T, B, H), states.dtype)
        dh = np.zeros((B, H), states.dtype)
        back = np.ascontiguousarray(p["U"].T)
        fresh = start.any(1)
        for t in range(T - 1, -1, -1):
            dh += ds[t]
            d = da[t]
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(dh, to_z[t], out=d[:, :H])
            np.multiply(dn[t], to_r[t], out=d[:, H : 2 * H])
            np.multiply(dn[t], r[t], out=d[:, 2 * H :])
            dh *= z[t]
            dh += d @ back
            if fresh[t]:
                dh *= ~start[t][:, None]
        flat = da.reshape(-1, 3 * H)
        grads["U"] += h.reshape(-1, H).T @ flat
        flat[:, 2 * H :] = dn.reshape(-1, H)
        grads["b"] += flat.sum(0)
        i = inputs.ravel()
        order = np.argsort(i.astype(np.uint16), kind="stable")
        i = i[order]
        edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        grads["E"][i[edge]] += np.add.reduceat(flat[order], edge, axis=0)


class Trainer:
    """Adam over windows; keeps its moments from one batch of documents to the next."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step, self.seen = net, rate, 0, 0
        self.m, self.s, self.work = (np.zeros(SIZE, np.float32) for _ in range(3))

    def learn(self, docs: list[np.ndarray]) -> None:
        net = self.net
        codes, owner = lanes(docs, LANES)
        h = np.zeros((len(codes), HIDDEN), np.float32)
        flat = np.zeros(SIZE, np.float32)
        for k, x, start, _ in net.windows(codes, owner, STEPS):
            flat[:] = 0
            grads = unpack(flat)
            states, h, held = net.run(x, start, h[: k.shape[1]], True)
            out, live, ds = net.log_probs(states, k, grads)
            net.backward(x, start, states, held, ds, grads)
            self.seen += len(live)
            flat /= max(len(live), LANES)
            self.step += 1
            work = self.work
            np.subtract(flat, self.m, out=work)
            work *= 0.1
            self.m += work
            np.multiply(flat, flat, out=work)
            work -= self.s
            work *= 0.002
            self.s += work
            np.sqrt(self.s, out=work)
            work += 1e-7
            np.divide(self.m, work, out=work)
            work *= self.rate * np.sqrt(1 - 0.998**self.step) / (1 - 0.9**self.step)
            net.flat += work


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's tokens, without the part of joined words."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    codes, owner = lanes(docs, LANES)
    h = np.zeros((len(codes), HIDDEN), np.float32)
    for k, x, start, own in net.windows(codes, owner, 32):
        states, h, _ = net.run(x, start, h[: k.shape[1]], False)
        lp, live = net.log_probs(states, k)
        c = k.ravel()[live]
        out += np.bincount(own.ravel()[live], lp.astype(np.float64) / np.log(10) + net.v.in_rare[c], len(docs))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts, summed in memory up to a bound on different words."""
    c: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            w = words(t.as_py())
            w.append(END)
            c.update(w)
            if len(c) > 400_000:
                yield _counted(c)
                c = Counter()
    yield _counted(c)


def _counted(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])


def _encode(share):
    """(doc_id, held_out, text) to codes as '<i4' bytes, what the vocabulary alone tells, and the words beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = share.value
        for b in batches:
            for s, e in tokens.groups(b.column(2).cast(pa.binary())):
                tail: list = []
                docs = [v.encode(t, tail) for t in b.column(2)[s:e].to_pylist()]
                base, known = [], []
                for d in docs:
                    near = d[d < COMMON]
                    base.append(float(v.base[near].sum()))
                    known.append(int(v.known[near].sum()))
                codes = pa.array([d.astype("<i4").tobytes() for d in docs], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[s:e], b.column(1)[s:e], pa.array([len(d) for d in docs], pa.int64()), pa.array(known, pa.int64()), pa.array(base), codes, pa.array(tail, pa.list_(pa.string()))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "codes", "tail"],
                )

    return run


def _held(column, most_tokens: int):
    """Slices of a column of codes with about so many tokens each: (start, end, codes of each document)."""
    for s, e in tokens.groups(column.cast(pa.binary()), 4 * most_tokens):
        yield s, e, [np.frombuffer(c.as_py(), "<i4") for c in column[s:e]]


def _train(share, flat: np.ndarray, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(Network(flat.copy(), share.value), rate)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for _, _, docs in _held(b.column(0), 1_500_000):
                held += docs
                size += sum(map(len, docs))
                if size > 1_500_000:
                    t.learn(held)
                    held, size = [], 0
        if held:
            t.learn(held)
        if t.seen:
            n = float(t.seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(t.net.flat.astype(np.float64) * n), pa.array(np.full(SIZE, n))], ["i", "v", "w"])

    return run


def _score_rows(share, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat, share.value)
        for b in batches:
            # Many texts at a time: a very long one then runs beside enough others to fill the lanes.
            for s, e, docs in _held(b.column(1), 4_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], pa.array(score(net, docs))], ["row", "net_score"])

    return run


def _rare_class(word):
    return F.pmod(F.crc32(F.encode(F.substring(word, 1, 2), "UTF-8")), F.lit(RARE)).cast("int")


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most COMMON words, the most frequent ones: all from the least count on at which they are not more. Counts are
    taken in steps of a sixteenth of an octave, so that the driver sees a bounded histogram and then these words."""
    step = F.floor(16 * F.log2("n")).cast("int")
    room, least = COMMON, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect():  # 1,024 rows at most
        if r["v"] > room:
            break
        room, least = room - r["v"], r["step"]
    if least is None:
        return []
    top = counts.where(step >= least).select("word", "n").toArrow()
    rows = zip(top.column("word").to_pylist(), top.column("n").to_pylist())
    return [(w.encode(), n) for w, n in sorted(rows, key=lambda r: (-r[1], r[0]))]


def vocabulary(train: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(count table, vocabulary) from the `text` column of all rows."""
    counts = common.materialize(train.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.groupBy(_rare_class(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # RARE rows
    class_n, class_v = np.zeros(RARE), np.zeros(RARE)
    for r in sums:
        class_n[r["c"]], class_v[r["c"]] = r["n"], r["v"]
    return counts, Vocabulary(_most_frequent(counts), int(class_n.sum()), int(class_v.sum()), class_n, class_v)


def fit(train: DataFrame, v: Vocabulary, share, rate: float = 0.008) -> np.ndarray:
    """Weights from the `codes` of all rows."""
    flat = first_weights(v)
    # Where training starts from: a short fit on a bounded sample of rows of bounded length.
    n = train.count()
    some = train.where(F.octet_length("codes") < 4 * WARM_TOKENS)
    if n > WARM_DOCS:
        some = some.where(F.pmod(F.xxhash64("row"), F.lit(n)) < 2 * WARM_DOCS)
    some = some.select("codes").limit(WARM_DOCS).collect()
    if some:
        t = Trainer(Network(flat, v), 0.01)
        docs = [np.frombuffer(r["codes"], "<i4") for r in some]
        for k in range(0, len(docs), LANES // 2):
            t.learn(docs[k : k + LANES // 2])
    summed = train.select("codes").mapInArrow(_train(share, flat, rate), "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
    got = summed.toPandas()  # SIZE rows
    if len(got):
        flat = np.empty(SIZE, np.float32)
        flat[got["i"].to_numpy()] = got["v"].to_numpy()
    return flat


def score_documents(docs: DataFrame, rate: float = 0.008) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = F.crc32(F.encode(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), "UTF-8")) % 5 == 1
    lean = docs.select("doc_id", held.alias("held_out"), "text")
    counts, v = vocabulary(lean.where(~F.col("held_out")))
    share = spark.sparkContext.broadcast(v)
    kind = lean.schema["doc_id"].dataType.simpleString()
    made = lean.mapInArrow(_encode(share), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, codes binary, tail array<string>")
    made = common.materialize(made.withColumn("row", F.monotonically_increasing_id()), "codes")
    flat = fit(made.where(~F.col("held_out")), v, share, rate)
    net = made.select("row", "codes").mapInArrow(_score_rows(share, flat), "row long, net_score double")
    net = common.materialize(net, "scores")
    tail = made.select("row", F.explode("tail").alias("word"))
    n = F.coalesce("n", F.lit(0)) + 0.5
    room = F.get(F.array(*[F.lit(float(x)) for x in v.rare_all]), _rare_class(F.col("word")))
    beyond = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.log10(n / F.lit(v.total + 0.5 * (v.distinct + 1)))).alias("b"), F.sum(F.log10(n / room)).alias("s"), F.count("n").alias("k")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return made.drop("tail", "codes").join(net, "row").join(beyond, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("k")).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("b")).alias("base_score"),
        (F.col("net_score") + zero("s")).alias("score"),
    )
