"""Best-fit packing of token documents into sequences of fixed length, in bulk-synchronous sweeps.

Documents of the same length are interchangeable, and so are open sequences with the same gap. The range-sorted
order of documents and of gaps is therefore a histogram with `length` classes on either side, whatever the corpus
size, and a sweep runs over classes: in each round, documents from the longest down meet the gaps from the smallest
that holds them up (their successors); where more documents than gaps meet, they are served by rank and the rest go
on to the next larger gap; every gap takes at most one document a round, all gaps are updated together, and rounds
repeat until nothing fits. Lengths are handled in tiers that halve, so small documents are left to close small
gaps. What the driver holds are counts of classes and runs of ranks, bounded by the sequence length alone. The
executors do the rest: they tokenize, rank each piece inside its length class by two-level counting (blocks of
65,536 rows, then offsets), and look up the run that holds its rank.

A document longer than a sequence is cut into full sequences; only its first piece may be shorter.

Defined cases: a null text is an empty one, which is one token (the end id); rows that repeat an id are packed each
for itself; null ids pass through; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

P = "__p_"


def sweep(counts: dict[int, int], length: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (class, first rank, ranks, first sequence, offset) for `counts` documents of each class, and the
    number of sequences. A placement puts rank r0+i of the class at the offset in sequence s0+i."""
    left = np.zeros(length + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    rank = np.zeros(length + 1, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[list[int]]] = [[] for _ in range(length + 1)]  # runs [first sequence, how many] by gap
    have = np.zeros(length + 1, np.int64)
    n_seq = 0

    def put(k: int, n: int, seq: int, gap: int) -> None:
        out.append((k, int(rank[k]), n, seq, length - gap))
        rank[k] += n
        left[k] -= n

    def open_new(k: int, n: int) -> None:
        nonlocal n_seq
        put(k, n, n_seq, length)
        if length - k:
            gaps[length - k].append([n_seq, n])
            have[length - k] += n
        n_seq += n

    def round_(low: int, high: int) -> int:
        """One bulk-synchronous round over classes low..high."""
        placed, updates = 0, []
        for k in range(high, low - 1, -1):
            g = k
            while left[k] and g <= length:
                step = np.flatnonzero(have[g:])
                if not len(step):
                    break
                g += int(step[0])
                run = gaps[g][-1]
                n = int(min(left[k], run[1]))
                put(k, n, run[0], g)
                placed += n
                if g - k:
                    updates.append((g - k, run[0], n))
                run[0] += n
                run[1] -= n
                have[g] -= n
                if not run[1]:
                    gaps[g].pop()
        for g, seq, n in updates:
            gaps[g].append([seq, n])
            have[g] += n
        return placed

    high = length
    for k in range(length, length // 2, -1):  # no two of these fit together
        if left[k]:
            open_new(k, int(left[k]))
    high = length // 2
    while high:
        low = high // 2 + 1
        while True:
            while round_(low, high):
                pass
            rest = left[low : high + 1]
            total = int((rest * np.arange(low, high + 1)).sum())
            if not total:
                break
            need = -(-total // length)  # sequences that what is left in this tier needs at least
            for k in range(high, low - 1, -1):
                n = int(min(left[k], need))
                if n:
                    open_new(k, n)
                    need -= n
                if not need:
                    break
        high = low - 1
    return out, n_seq


_PIECES = "piece int, start long, length long, ids_crc32 long"


def _piece_rows(id_at: int, text_at: int, path: str | None, length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            ids, texts = b.column(id_at), b.column(text_at).cast(pa.binary())
            for s, e in tokens.groups(texts):
                src, piece, start, size, crc, raw = [], [], [], [], [], []
                flat, edge = enc.encode_flat(texts[s:e].to_pylist())
                # The end id behind every text.
                flat = np.insert(flat, edge[1:], end_id).astype("<u4")
                edge += np.arange(len(edge))
                data = memoryview(flat).cast("B")
                for i, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist()), s):
                    n = hi - lo
                    first = n if n <= length else n % length or length
                    at = 0
                    for k in range(1 + -(-(n - first) // length)):
                        upto = first + k * length
                        part = data[4 * (lo + at) : 4 * (lo + upto)]
                        src.append(i)
                        piece.append(k)
                        start.append(at)
                        size.append(upto - at)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(bytes(part))
                        at = upto
                cols = [ids.take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _look_up(placements: list[tuple[int, int, int, int, int]], names: list[str]):
    p = np.array(sorted(placements), np.int64).reshape(-1, 5)
    span = int(p[:, 1].max() + 1) if len(p) else 1
    first = p[:, 0] * span + p[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            k, r = col("length"), col(P + "rank")
            # Ranks beyond the last run's first still belong to it, so they are capped for the search.
            i = np.searchsorted(first, k * span + np.minimum(r, span - 1), "right") - 1
            seq, off = p[i, 3] + r - p[i, 1], p[i, 4]
            keep = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = 2048, end_id: int = 0, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = lean.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {_PIECES}" + (", ids binary" if with_ids else "")
    made = lean.mapInArrow(_piece_rows(0, 1, vocabulary, length, end_id, with_ids), schema)
    made = common.materialize(made.withColumn(P + "row", F.monotonically_increasing_id()), "pieces")
    made = made.withColumn(P + "block", F.shiftright(P + "row", 16))
    per = common.materialize(made.groupBy("length", P + "block").agg(F.count("*").alias(P + "n")), "classes")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum(P + "n").alias("n")).collect()}  # `length` rows at most
    placements, _ = sweep(counts, length)
    before = Window.partitionBy("length").orderBy(P + "block").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", P + "block", F.coalesce(F.sum(P + "n").over(before), F.lit(0)).alias(P + "first"))
    inside = Window.partitionBy(P + "block", "length").orderBy(P + "row")
    ranked = made.withColumn(P + "in", F.row_number().over(inside) - 1).join(first, ["length", P + "block"])
    ranked = ranked.withColumn(P + "rank", F.col(P + "in") + F.col(P + "first"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    out = ranked.select(*names, P + "rank")
    return out.mapInArrow(_look_up(placements, names), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, n_tokens) of a packing made with ids; a sequence has at most `length` tokens."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    join = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", join.alias("ids"), "n_tokens")


def packing_query(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
