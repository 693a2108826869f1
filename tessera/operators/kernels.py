"""Distances as blocks of matrix products, inside tasks.

Codes are whole numbers of at most 15 bits, so sums of squares over some hundred
dimensions stay below 2^53 and products in double precision are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of records, and of queries, per product.
RECORDS, QUERIES = 4096, 1024
#: Rows of queries held against all boxes at once, distances computed at once, and rows read at once of a shuffle.
BOUNDS, CELLS, ROWS = 64, 1 << 19, 1 << 15


def codes(df, dim: int, prefix: str = "q") -> list[str]:
    """The columns of a vector: one array column ``prefix``, or ``prefix``0.. unrolled.

    Arrays keep plans narrow; a projection of a hundred columns takes longer to
    compile than a few thousand rows take to read.
    """
    return [prefix] if prefix in df.columns else [f"{prefix}{i}" for i in range(dim)]


def matrix(batch: pa.RecordBatch | pa.Table, dim: int, prefix: str = "q") -> np.ndarray:
    """A vector's columns as a matrix of doubles, one row per vector."""
    if prefix in batch.schema.names:
        x = batch.column(prefix)
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    out = np.empty((batch.num_rows, dim))
    for i in range(dim):
        out[:, i] = batch.column(f"{prefix}{i}").to_numpy()
    return out


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    x = batch.column(name)
    return x.to_numpy() if isinstance(x, pa.ChunkedArray) else x.to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = RECORDS) -> Iterator[pa.Table]:
    """Batches put together to ``rows`` or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of ``a`` and of ``b``."""
    d = a @ b.T
    d *= -2.0
    d += np.einsum("ij,ij->i", a, a)[:, None]
    d += np.einsum("ij,ij->i", b, b)
    return d


def before(q: np.ndarray) -> np.ndarray:
    """Rows whose product with ``beside`` of others is their squared distance, exactly."""
    return np.column_stack([-2.0 * q, np.einsum("ij,ij->i", q, q), np.ones(len(q))])


def beside(r: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([r, np.ones(len(r)), np.einsum("ij,ij->i", r, r)]).T)


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from the rows of ``q`` to boxes; an inverted box is far from all."""
    out, d = np.zeros((len(q), len(low))), np.empty((len(q), len(low)))
    low, high = low.T.copy(), high.T.copy()
    inverted = np.flatnonzero((low > high).any(axis=0))
    for i in range(q.shape[1]):
        x = q[:, i, None]
        np.clip(x, low[i], high[i], out=d)
        np.subtract(x, d, out=d)
        if len(inverted):
            d[:, inverted] = np.maximum(np.maximum(x - high[i, inverted], low[i, inverted] - x), 0.0)
        np.multiply(d, d, out=d)
        out += d
    return out


def nearest(d: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` least by (single-precision distance, id),
    in that order, without infinite ones and those over ``bound`` of the row."""
    near = d.astype(np.float32)
    limit = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(near), np.finfo(np.float32).max, np.float32)
    if bound is not None:
        limit = np.minimum(limit, bound)
    row, col = np.nonzero(near <= limit[:, None])
    order = np.lexsort((ids[col], near[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)  # where the row's places begin
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def first_of(row: np.ndarray, col: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` places of each row, whose places lie together."""
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def nearer(d: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` without places that reach their row's ``limit`` in single precision."""
    if d.shape[1] > k and limit.max() > 1e19:  # nothing to hold them against yet
        row, col = nearest(d, ids, k)
    else:
        row, col = np.nonzero(d < limit[:, None])
    near = d[row, col].astype(np.float32)
    below = near < limit[row]
    row, col, near = row[below], col[below], near[below]
    order = np.lexsort((ids[col], near, row))
    return first_of(row[order], col[order], k)
