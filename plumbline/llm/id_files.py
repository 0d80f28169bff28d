"""Token-id files: whole texts as ids, in ascending doc_id order, in range-coded blocks (see id_coder).

Documents are range-sorted by id, so each partition is a run of neighbouring documents (a part). A part is one stream
of ids, every document closed by an end id, and is cut into blocks of `id_coder.BLOCK` ids wherever they end; a document
may run over many blocks, so memory follows the block and not the document's ids. A row of the files is a block: part,
number in the part, ids, the frame, and the ids and lengths of the documents that start in it. Blocks are coded by
themselves and carry checksums, so each can be read, checked and repaired alone. Spark's writer puts the rows into
Parquet, hence the format lives in any store that Spark can reach and a lost task is simply written again.

Reading brings the blocks of a part together in order, decodes block by block, and hands out documents with their
place: the ids of all documents before it. The driver sees one number a part.

Defined cases: a null text is an empty one (its end id only); rows that repeat an id are documents of their own, in the
order of their texts' hashes; null ids come first; an empty table gives files without rows; other columns are not
read. A damaged block raises id_coder.Damaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, id_coder, tokens

P = "__i_"
END_ID = 2


def _blocks(path: str | None, end_id: int, block: int, id_type: pa.DataType):
    """Sorted (doc_id, text) to blocks (part, seq, n_ids, doc_ids, doc_lens, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = tokens.encoder(path)
        vocabulary = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        held, size, seq, ids, lens = [], 0, 0, [], []

        def row() -> pa.RecordBatch:
            nonlocal held, size, seq, ids, lens
            own = np.concatenate(held) if held else np.empty(0, np.uint32)
            frame = id_coder.encode(own, vocabulary)
            cols = [
                pa.array([part], pa.int32()),
                pa.array([seq], pa.int64()),
                pa.array([len(own)], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([lens], pa.list_(pa.int64())),
                pa.array([frame], pa.binary()),
            ]
            held, size, seq, ids, lens = [], 0, seq + 1, [], []
            return pa.RecordBatch.from_arrays(cols, ["part", "seq", "n_ids", "doc_ids", "doc_lens", "frame"])

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            for s, e in tokens.groups(texts):
                flat, edge = enc.encode_flat(texts[s:e].to_pylist())
                flat = np.insert(flat, edge[1:], end_id)
                edge += np.arange(len(edge))
                at = 0  # ids of the group that are in a block already
                for key, lo, hi in zip(keys[s:e], edge[:-1].tolist(), edge[1:].tolist()):
                    ids.append(key)
                    lens.append(hi - lo)
                    while size + hi - at >= block:
                        cut = at + block - size
                        held.append(flat[at:cut])
                        at = cut
                        yield row()
                if at < len(flat):
                    held.append(flat[at:])
                    size += len(flat) - at
        if size or ids:
            yield row()

    return run


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, block: int = id_coder.BLOCK) -> None:
    """Write the ids of all texts to `path`. One shuffle of the texts, by range of doc_id."""
    spark = docs.sparkSession
    t = F.coalesce(docs[text], F.lit(""))
    lean = docs.select(docs[doc_id].alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("tie"))
    order = [F.asc_nulls_first("doc_id"), "tie", "text"]
    # The text decides between equal hashes inside a part only, so the sampled bounds are two numbers each.
    dealt = lean.repartitionByRange(common.n_partitions(spark), *order[:2]).sortWithinPartitions(*order)
    kind = lean.schema["doc_id"].dataType
    schema = f"part int, seq long, n_ids long, doc_ids array<{kind.simpleString()}>, doc_lens array<long>, frame binary"
    blocks = dealt.select("doc_id", "text").mapInArrow(_blocks(vocabulary, end_id, block, _arrow(kind)), schema)
    blocks.write.parquet(path)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _documents(first: dict[int, int], with_ids: bool, id_type: pa.DataType):
    """Blocks in order to documents (doc_id, start, n_tokens, ids_crc32[, ids])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, waiting, crc, got, parts = None, 0, [], 0, 0, []
        rows: list[list] = [[], [], [], [], []]

        def batch() -> pa.RecordBatch:
            nonlocal rows
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
            n = 5 if with_ids else 4
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:n], kinds)], names[:n])
            rows = [[], [], [], [], []]
            return out

        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                now = col["part"][i].as_py()
                if now != part:
                    if waiting:
                        raise id_coder.Damaged(f"part {part} ends inside a document")
                    part, at = now, first[now]
                waiting += list(zip(col["doc_ids"][i].as_py(), col["doc_lens"][i].as_py()))
                raw = memoryview(id_coder.decode(col["frame"][i].as_py()).tobytes())
                have, done = 0, 0
                for key, n in waiting:
                    piece = raw[have : have + 4 * (n - got)]
                    crc = zlib.crc32(piece, crc)
                    if with_ids:
                        parts.append(bytes(piece))
                    have += len(piece)
                    got += len(piece) // 4
                    if got < n:
                        break
                    for c, v in zip(rows, (key, at, n, crc, b"".join(parts))):
                        c.append(v)
                    at, crc, got, parts, done = at + n, 0, 0, [], done + 1
                if have != len(raw):
                    raise id_coder.Damaged(f"part {part} has ids of no document")
                waiting = waiting[done:]
                yield batch()
        if waiting:
            raise id_coder.Damaged(f"part {part} ends inside a document")

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids as '<u4' bytes."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a part
    first, at = {}, 0
    for r in sums:
        first[r["part"]] = at
        at += r["n"]
    schema = f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    together = blocks.select("part", "seq", "doc_ids", "doc_lens", "frame").repartitionByRange(max(1, len(sums)), "part").sortWithinPartitions("part", "seq")
    return together.mapInArrow(_documents(first, with_ids, _arrow(kind)), schema)


def ids_query(docs: DataFrame) -> DataFrame:
    """Every document written and read back."""
    spark = docs.sparkSession
    path = common.new_path(spark, "ids")
    write(docs.select("doc_id", "text"), path)
    return read(spark, path)
