"""Shared helpers: scratch tables, table access, column binding, Arrow text access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import filesystem, give_back, scratch_path, scratch_scope, ship, stage, stage_arrow, stage_small  # noqa: F401  (used by the operators)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns, base: str) -> str:
    """``base``, with underscores after it until no column is called so."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn`` (a let-binding)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def arrow_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def doc_blocks(bounds: np.ndarray, limit: int = 1 << 20):
    """Ranges (i, j) of documents with about ``limit`` bytes, one at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def list_column(flat: np.ndarray, lengths) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


#: Ids that may be broadcast (8 bytes each, some tens of MB as a hash table).
BROADCAST_IDS = 1_000_000


def without_keys(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``gone``, a staged table of one column.

    Up to BROADCAST_IDS keys, counted, are broadcast, so texts need no shuffle;
    more are joined by shuffle.
    """
    name = free_name(docs.columns, "gone")
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = gone.toDF(name)
    return docs.join(F.broadcast(gone) if small else gone, key == F.col(name), "left_anti")


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    return without_keys(docs, F.col(f"`{id_col}`").cast("bigint"), gone)
