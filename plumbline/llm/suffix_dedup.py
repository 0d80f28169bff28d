"""Removal of repeated 200-byte strings through suffix arrays built by induced sorting.

A suffix array over the whole corpus would be one sequential job, so the text is dealt into shards that keep every
possible match together. Each 200-byte window is assigned to the smallest 64-byte string in it (by hash, leftmost);
equal windows hold the same one. Neighbouring windows with the same assignment form a segment, on average 270 bytes
long, and segments are dealt by the string they were assigned to. Segments whose string occurs nowhere else hold no
repeated window and go no further. The rest meet in shards: equal segments are one with a weight, each shard's
segments are joined by a stop symbol, sorted by induced sorting (see suffix_array), and their permuted common
prefixes tell which windows have an equal neighbour. Windows found are joined back to where they occur, merged into
spans and removed.

Hot strings: equal segments are counted before they are moved, so thousands of copies are one segment with a weight.
The different segments around one string (a common line) are split by more of what stands around it: where they hold
more than `HOT_BYTES`, their windows are assigned anew to the smallest 128-byte string, then to one of 184 bytes, and
at last to themselves, at which point equal windows are one segment. Every window is sorted in a shard of at most
`SHARD_BYTES + HOT_BYTES`, at whichever length, and no task holds more. Joins on hot strings are plain joins of one
row against many, which adaptive execution splits.

Texts are looked up by their md5: equal texts have equal results. They are written once, bucketed by it, so both
reads of the text by key need no further shuffle of the text. Segments are taken for equal by a 128-bit hash of their
bytes; that is the only place where bytes are not compared themselves.

Defined cases: a null text is empty (0 bytes, none removed); rows that repeat an id are rows of their own, and their
text then occurs twice; null ids pass through; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, suffix_array, tokens

P = "__d_"
WINDOW = 200
#: Bytes of the string that windows are dealt by: the first for all, the next ones for what is still hot.
GRAMS = (64, 128, 184, WINDOW)
#: Bytes of different segments around one string from which on they are split.
HOT_BYTES = 500_000
SHARD_BYTES = 2_000_000
#: Text that is hashed at once.
SLICE_BYTES = 1_000_000
_M = 0x9E3779B97F4A7C15 | 1
_powers: dict = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", 0) < n:
        size = max(1 << 20, 1 << int(n).bit_length())
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, m in ((up, _M), (down, pow(_M, -1, 1 << 64))):
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(m, done, 1 << 64))
                done += step
        _powers.update(n=size, up=up, down=down)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def segments(texts: list[bytes], window: int = WINDOW, gram: int = GRAMS[0]):
    """Segments of the texts: (text number, first window, windows, string key as arrays, 16-byte hashes as a list)."""
    import xxhash

    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = b"".join(texts)
    buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none, none, []
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    g = _mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    low = np.uint64(0xFFFFFFFF)
    ranked = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    w = window - gram + 1
    n_win = n - window + 1
    rows = -(-len(ranked) // w)
    padded = np.full(rows * w, np.uint64(2**64 - 1))
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n_win], ahead[w - 1 : w - 1 + n_win]) & low).astype(np.int64)
    starts = np.cumsum(lens) - lens
    whole = lens >= window
    step = np.zeros(n_win + 1, np.int32)
    step[starts[whole]] += 1
    step[starts[whole] + lens[whole] - window + 1] -= 1
    valid = np.cumsum(step[:-1]) > 0
    opens = valid.copy()
    opens[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first_of_text = starts[whole]
    opens[first_of_text] = True
    first = np.flatnonzero(opens)
    text = np.searchsorted(starts, first, "right") - 1
    # Empty texts share their start with the next one; the last text with that start is the one with bytes.
    last = starts[text] + lens[text] - window + 1
    after = np.minimum(np.r_[first[1:], n_win], last)
    size = after - first
    view = memoryview(raw)
    content = [xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(first.tolist(), (after - 1 + window).tolist())]
    return text, first - starts[text], size, g[at[first]].view(np.int64), content


def _segment_rows(most_bytes: int, gram: int):
    """Segments of each batch, about `most_bytes` of text at a time; longer texts are read in slices that overlap, so
    that each window is in one slice whole."""

    def slices(texts):
        group, size = [], 0
        for i, t in enumerate(texts):
            t = t.as_py()
            for at in range(0, max(len(t) - WINDOW + 1, 1), most_bytes):
                part = t[at : at + most_bytes + WINDOW - 1]
                if group and size + len(part) > most_bytes:
                    yield group
                    group, size = [], 0
                group.append((i, at, part))
                size += len(part)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, copies = b.column(0), b.column(1)
            for group in slices(b.column(2).cast(pa.binary())):
                part, at, n, key, content = segments([g[2] for g in group], gram=gram)
                took = pa.array(np.array([g[0] for g in group], np.int64)[part])
                at = at + np.array([g[1] for g in group], np.int64)[part]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(took), copies.take(took), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(content, pa.binary())],
                    ["uid", "copies", "at", "n", "key", "sid"],
                )

    return run


_SEGMENTS = "uid binary, copies long, at int, n int, key long, sid binary"


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(where each value starts, and the last one's end; the bytes) of a binary column, without a copy."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, list of segments) to (key, sid, n, weight, bytes), a few megabytes at a time."""
    for b in batches:
        texts = b.column(0).cast(pa.binary())
        start, data = _bytes_of(texts)
        segs = b.column(1)
        row = np.repeat(np.arange(len(segs)), segs.value_lengths().to_numpy(zero_copy_only=False))
        flat = segs.flatten()
        col = dict(zip([f.name for f in flat.type], flat.flatten()))
        size = col["n"].to_numpy(zero_copy_only=False).astype(np.int64) + WINDOW - 1
        first = start[row] + col["at"].to_numpy(zero_copy_only=False)
        upto = np.cumsum(size)
        s = 0
        while s < len(size):
            e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + 2_000_000)))
            cut = data[tokens.ranges(first[s:e], size[s:e])]
            edges = np.concatenate([[0], np.cumsum(size[s:e])]).astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(edges), pa.py_buffer(cut)])
            yield pa.RecordBatch.from_arrays([*[col[c].slice(s, e - s) for c in ("key", "sid", "n", "weight")], parts], ["key", "sid", "n", "weight", "bytes"])
            s = e


_CUT = "key long, sid binary, n int, weight long, bytes binary"


def repeated_windows(data: np.ndarray, lens: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur anywhere else: (segment, first window, last window). The segments' bytes are one
    behind the other in `data`; a segment with a weight above one occurs elsewhere as a whole."""
    starts = np.cumsum(lens + 1) - lens - 1
    t = np.full(int(lens.sum()) + len(lens) + 1, 1, np.uint16)  # 1 is the stop symbol
    t[tokens.ranges(starts, lens)] = data.astype(np.uint16) + 2
    t[-1] = 0
    sa = suffix_array.suffix_array(t, 258)
    plcp = suffix_array.common_prefixes(t, sa, 1)
    deep = np.flatnonzero(plcp[sa] >= window)
    hit = np.zeros(len(t) + 1, bool)
    hit[sa[deep]] = True
    hit[sa[deep - 1]] = True
    copied = weights > 1
    hit[tokens.ranges(starts[copied], (lens - window + 1)[copied])] = True
    edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    if hit[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[::2], edge[1::2] - 1
    which = np.searchsorted(starts, first, "right") - 1
    return which, first - starts[which], last - starts[which]


_RUNS = "sid binary, first int, last int"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sid, n, weight, bytes) sorted by key, packed into shards of whole keys, to runs of repeated windows."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        start, data = _bytes_of(rows.column("bytes").chunk(0))
        lens = np.diff(start)
        which, first, last = repeated_windows(data[start[0] : start[-1]], lens, rows.column("weight").to_numpy())
        sid = rows.column("sid").chunk(0).take(pa.array(which))
        return pa.RecordBatch.from_arrays([sid, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["sid", "first", "last"])

    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            b = pa.Table.from_batches([b])
            held = b if held is None else pa.concat_tables([held, b])
        if held is None or not held.num_rows:
            continue
        key = held.column("key").to_numpy()
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1  # where a key starts that is not the first; the last may go on
        if b is None:
            edge = np.append(edge, len(key))
        upto = np.concatenate([[0], np.cumsum(held.column("n").to_numpy().astype(np.int64) + WINDOW - 1)])
        done = 0
        while len(edge):
            at = int(np.searchsorted(upto[edge], upto[done] + SHARD_BYTES))
            if at == len(edge):
                if b is not None or edge[-1] <= done:
                    break
                at -= 1
            yield solve(held.slice(done, int(edge[at]) - done))
            done = int(edge[at])
            edge = edge[at + 1 :]
        held = held.slice(done)


class _Corpus:
    """Distinct texts (uid, copies, bytes), bucketed by uid, a key made of the text's md5."""

    def __init__(self, docs: DataFrame, text: str):
        self.spark = spark = docs.sparkSession
        n = common.n_partitions(spark)
        self.name = f"plumbline_texts_{uuid.uuid4().hex}"
        t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        once = docs.select(F.unhex(F.md5(t)).alias("uid"), t.alias("text")).groupBy("uid").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        path = common.new_path(spark, "texts")
        once.select("uid", "copies", F.encode("text", "UTF-8").alias("bytes")).repartition(n, "uid").write.bucketBy(n, "uid").option("path", path).saveAsTable(self.name)
        self.table = spark.read.table(self.name)

    def drop(self) -> None:
        """Take the table out of the catalog once what was made of it is written; its files go with the session."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _covered(units: DataFrame, level: int) -> DataFrame:
    """(uid, s, e): runs of repeated windows, first and last, of byte strings (uid, copies, bytes)."""
    n = common.n_partitions(units.sparkSession)
    found = units.where(F.octet_length("bytes") >= WINDOW).select("uid", "copies", "bytes").mapInArrow(_segment_rows(SLICE_BYTES, GRAMS[level]), _SEGMENTS)
    found = common.materialize(found, "segments")
    again = found.groupBy("key").agg(F.sum("copies").alias("times")).where(F.col("times") > 1).select("key")
    hits = common.materialize(found.join(again, "key", "left_semi"), "hits")
    lead = hits.groupBy("sid").agg(F.sum("copies").alias("weight"), F.min(F.struct("uid", "at", "n", "key")).alias("lead"))
    lead = lead.select("sid", "weight", "lead.*")
    around = lead.groupBy("key").agg(F.count("*").alias("different"), F.sum(F.col("n") + WINDOW - 1).alias("size"))
    splits = GRAMS[level] < WINDOW
    kind = F.when(F.col("different") == 1, 0).when((F.col("size") <= HOT_BYTES) | F.lit(not splits), 1).otherwise(2)
    lead = common.materialize(lead.join(around.select("key", kind.alias("kind")), "key"), "leads")
    cut = lambda kind: units.join(
        lead.where(F.col("kind") == kind).groupBy("uid").agg(F.collect_list(F.struct("key", "sid", "n", "weight", "at")).alias("segs")), "uid"  # bounded by the text's length
    ).select("bytes", "segs").mapInArrow(_cut_out, _CUT)
    # A segment that is alone under its string has been counted more than once, so all of it is elsewhere too.
    runs = lead.where(F.col("kind") == 0).select("sid", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    runs = runs.unionByName(cut(1).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_shards, _RUNS))
    if splits and not lead.where(F.col("kind") == 2).isEmpty():
        split = cut(2).select(F.col("sid").alias("uid"), F.col("weight").alias("copies"), "bytes")
        split = _covered(common.materialize(split, "hot"), level + 1)
        runs = runs.unionByName(split.select(F.col("uid").alias("sid"), F.col("s").alias("first"), F.col("e").alias("last")))
    runs = common.materialize(runs, "runs")
    return hits.select("uid", "at", "sid").join(runs, "sid").select("uid", (F.col("at") + F.col("first")).alias("s"), (F.col("at") + F.col("last")).alias("e"))


def spans(corpus: _Corpus) -> DataFrame:
    """(uid, spans): an array of (s, e), covered bytes of that text, unmerged."""
    span = F.struct("s", (F.col("e") + WINDOW).alias("e")).alias("span")
    return _covered(corpus.table, 0).select("uid", span).groupBy("uid").agg(F.collect_list("span").alias("spans"))  # bounded by the text's length


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def keep_rest(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in removed:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that only part of would go."""
    mid = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for s, e in removed:
        while s < e and mid(s):
            s += 1
        while e > s and mid(e):
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for text, found in zip(b.column(1), b.column(2)):
            raw, cut = text.as_py(), merged(found.as_py())
            rest = keep_rest(raw, cut)
            for col, v in zip(out, (len(raw), len(raw) - len(rest), len(cut), hashlib.sha256(rest).hexdigest())):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, found in zip(b.column(1), b.column(2)):
            raw = text.as_py()
            out.append(keep_rest(raw, whole_characters(raw, merged(found.as_py()))).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["uid", "text"])


def suffix_query(docs: DataFrame) -> DataFrame:
    corpus = _Corpus(docs.select("doc_id", "text"), "text")
    each = corpus.table.join(spans(corpus), "uid", "left").select("uid", "bytes", "spans")
    done = each.mapInArrow(_digest, "uid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    done = common.materialize(done, "digests")
    corpus.drop()
    ids = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("uid"))
    return ids.join(done, "uid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with repeated passages cut out of the text (whole characters only) and n_chars brought up to date.
    Documents of which nothing but white space is left go; texts that were blank before stay as they are."""
    corpus = _Corpus(docs, text)
    changed = corpus.table.join(spans(corpus), "uid").select("uid", "bytes", "spans").mapInArrow(_clean, "uid binary, text string")
    changed = common.materialize(changed.select(F.col("uid").alias(P + "uid"), F.col("text").alias(P + "new")), "cleaned")
    corpus.drop()
    own = docs.withColumn(P + "uid", F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    out = own.join(changed, P + "uid", "left")
    out = out.where(F.col(P + "new").isNull() | (F.translate(P + "new", common.BLANKS, "") != ""))
    value = F.coalesce(F.col(P + "new"), F.col(f"`{text}`"))
    cols = []
    for f in docs.schema.fields:
        if f.name == text:
            cols.append(value.alias(text))
        elif f.name == n_chars and isinstance(f.dataType, (T.LongType, T.IntegerType)):
            cols.append(F.when(F.col(P + "new").isNotNull(), F.length(P + "new").cast(f.dataType)).otherwise(F.col(f"`{n_chars}`")).alias(n_chars))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return out.select(*cols)
