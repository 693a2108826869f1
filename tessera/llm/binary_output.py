"""Token ids as binary shards: frequency ranks in bytes, control bits apart.

Ids are replaced by their rank by corpus frequency, so frequent tokens need one
byte.  A rank takes 1 to 4 bytes; its length minus one stands in two bits of a
control byte that serves four ids.  Control bytes are kept apart from data
bytes, so a reader finds all lengths by one numpy table lookup and gathers all
values without a loop over ids.

A shard file: magic and version, then blocks of documents, then an end mark with
the numbers of documents and ids.  A block: numbers of documents, of control and
of data bytes, the documents' ids and lengths, control bytes, data bytes.  Blocks
are written and read one at a time, so a shard's size is no matter of memory; a
file without its end mark is refused.  The rank table (one entry per vocabulary
id) is written once beside the shards.

Files are written through ``pyarrow.fs`` under a name of the task attempt and
then renamed, so a lost executor or a second attempt leaves no partial shard.

Defined results: a null or empty text is the end id alone; repeated rows are
written once each, ties in document id in order of their ids' crc32, then of their
place in the input; null ids come first; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import doc_blocks, filesystem, scratch_path, stage, stage_arrow
from .tokens import encoder, with_end

MAGIC = b"TSRTOK02"
_HEAD = "<QQQ"
#: Data bytes of a shard, about.
SHARD = 64 << 20
NULL_ID = -(1 << 63)
#: Bytes of a control byte's four values, and where each begins.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: Ids coded at once; a longer document is a block of its own.
_BLOCK = 1 << 18
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def _places(lens: np.ndarray) -> np.ndarray:
    """Where each id's control code stands: every document begins a new control byte."""
    room = -(-lens // 4) * 4
    return np.repeat(np.cumsum(room) - room - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def encode_ranks(ranks: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of the uint32 ``ranks`` of documents with
    ``lens`` ids, and data bytes per document."""
    if not len(ranks):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(len(lens), np.int64)
    code = (ranks > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if ranks.max() > limit:
            code += ranks > limit
    padded = np.zeros(int((-(-lens // 4)).sum()) * 4, np.uint8)
    padded[_places(lens)] = code
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    width = int(code.max()) + 1
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    upto = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=upto[1:])
    extra = np.zeros(len(code) + 1, np.int64)
    np.cumsum(code, out=extra[1:])
    return control, raw[np.arange(width) <= code[:, None]], lens + np.diff(extra[upto])


def decode_ranks(control: np.ndarray, data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The inverse of ``encode_ranks``: lengths by table lookup, values by gather."""
    if not lens.sum():
        return np.zeros(0, np.uint32)
    sizes = _SIZES[control].ravel()[_places(lens)]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    room = np.concatenate([data, np.zeros(3, np.uint8)])
    value = room[at].astype(np.uint32)
    for k in range(1, int(sizes.max())):
        value |= room[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _MASKS[sizes - 1]


def _tokenize(tokenizer: str, end: int):
    def run(batches):
        enc = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, n, ids in enc.encode_column(batch.column(1)):
                ids, at = with_end(n, ids, end)
                rows = np.arange(row, row + len(n))
                row += len(n)
                offsets = pa.py_buffer((at * enc.dtype.itemsize).astype(np.int32))
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(ids)])
                tie = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(n)), pa.array(tie, pa.int64()), raw, pa.array(rows)], ["doc_id", "tie", "ids", "row"])

    return run


def _flat_ids(col: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the documents of a binary column, and all their ids."""
    at = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = col.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype) if at[-1] > at[0] else np.zeros(0, dtype)
    return (at - at[0]) // ids.dtype.itemsize, ids


def _count(vocab: int, dtype: str):
    def run(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:  # one count over the batch's ids, not one per document
            total += np.bincount(_flat_ids(batch.column(0), dtype)[1], minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return run


def _write_shards(folder: str, rank_of: np.ndarray, dtype: str):
    """Writes the documents of each task, in order, as one shard."""

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        ctx = TaskContext.get()
        target, path = filesystem(folder)
        name = f"shard-{ctx.partitionId():08d}.bin"
        part = f"{path}/.{name}.{ctx.taskAttemptId()}.{uuid.uuid4().hex}"
        n_docs = count = 0
        with target.open_output_stream(part) as out:
            out.write(MAGIC)
            for batch in chain([first], batches):
                docs = batch.column(0).to_pylist()
                at, ids = _flat_ids(batch.column(1), dtype)
                n = np.diff(at)
                for i, j in doc_blocks(at, _BLOCK):
                    control, data, _ = encode_ranks(rank_of[ids[at[i] : at[j]]], n[i:j])
                    out.write(struct.pack(_HEAD, j - i, len(control), len(data)))
                    out.write(np.array([NULL_ID if d is None else d for d in docs[i:j]], "<i8").tobytes())
                    out.write(n[i:j].astype("<u8").tobytes())
                    out.write(control.tobytes())
                    out.write(data.tobytes())
                n_docs, count = n_docs + len(docs), count + int(at[-1])
            out.write(struct.pack(_HEAD, 0, n_docs, count))
        if not n_docs:
            target.delete_file(part)
            return
        target.move(part, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([ctx.partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([count], pa.int64())],
            ["shard", "path", "n_docs", "n_tokens"],
        )

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 2, shards: int | None = None, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write ``docs`` as shards in ascending id order; returns the manifest
    (shard, path, n_docs, n_tokens), which is also written to ``folder``.

    ``shards`` defaults to the session's shuffle partitions, or to more if shards
    would be larger than SHARD bytes.
    """
    spark: SparkSession = docs.sparkSession
    enc = encoder(tokenizer)
    dtype = enc.dtype.str
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ids = stage_arrow(src, _tokenize(tokenizer, end), "doc_id bigint, tie bigint, ids binary, row bigint", "ids")
    # One row per vocabulary id.
    freq = ids.select("ids").mapInArrow(_count(enc.vocab, dtype), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(enc.vocab, np.int64)
    for r in freq:
        n[r["id"]] = r["n"]
    by_rank = np.lexsort((np.arange(enc.vocab), -n)).astype(np.uint32)
    rank_of = np.empty(enc.vocab, np.uint32)
    rank_of[by_rank] = np.arange(enc.vocab, dtype=np.uint32)
    target, path = filesystem(folder)
    target.create_dir(path, recursive=True)
    with target.open_output_stream(f"{path}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())
    if not shards:
        size = int((n * (1 + (rank_of > 0xFF) + (rank_of > 0xFFFF))).sum())
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    ordered = ids.repartitionByRange(shards, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    manifest = ordered.select("doc_id", "ids").mapInArrow(
        _write_shards(folder, rank_of, dtype), "shard bigint, path string, n_docs bigint, n_tokens bigint"
    )
    return stage(manifest, "manifest")


def read_shard(uri: str, by_rank: np.ndarray):
    """Documents of a shard as (doc_id, ids), block by block."""
    target, path = filesystem(uri)
    with target.open_input_stream(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        n_docs = count = 0
        while True:
            head = f.read(struct.calcsize(_HEAD))
            if len(head) < struct.calcsize(_HEAD):
                raise ValueError(f"a token shard without its end: {uri}")
            n, c_len, d_len = struct.unpack(_HEAD, head)
            if not n:
                if (n_docs, count) != (c_len, d_len):
                    raise ValueError(f"a token shard that lost blocks: {uri}")
                return
            docs = np.frombuffer(f.read(8 * n), "<i8").tolist()
            lens = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
            control, data = np.frombuffer(f.read(c_len), np.uint8), np.frombuffer(f.read(d_len), np.uint8)
            ids = by_rank[decode_ranks(control, data, lens)]
            at = np.concatenate([[0], np.cumsum(lens)]).tolist()
            for k in range(n):
                yield (None if docs[k] == NULL_ID else docs[k]), ids[at[k] : at[k + 1]]
            n_docs, count = n_docs + n, count + at[-1]


def _digests(uri: str, by_rank: np.ndarray, start: int):
    for doc, ids in read_shard(uri, by_rank):
        yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
        start += len(ids)


def _read(folder: str):
    def run(batches):
        target, path = filesystem(folder)
        with target.open_input_stream(f"{path}/ranks.bin") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for rows in batched(_digests(uri, by_rank, start), 4096):
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files.

    The running start of each shard is a window over the manifest, which has
    one row per shard.
    """
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    spread = placed.select("path", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")
