"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become pieces: a document and its separator id, or, if longer than a
sequence, pieces of full length after a first one that may be shorter.  What is
packed is the histogram of piece lengths (one number per possible length, so
its size doesn't grow with the data):

1. Martello-Toth reduction: the longest open length is paired with the set that
   provably dominates all others that fit beside it (nothing fits; one piece
   fills the rest exactly; only single pieces fit; the largest single piece is
   no smaller than the best pair or triple can be).  Such sequences are final
   and the instance shrinks, until no length is reducible.
2. Best-fit decreasing packs the rest, again on counts.

The result is a list of patterns (how many sequences, with which lengths at
which offsets).  A piece then finds its place by its rank among the pieces of
its length; ranks are counted per task and shifted by the tasks before it, so a
length that a third of all pieces share is never sorted in one place.

Defined results: a null or empty text has the separator only (one token);
repeated rows are packed once each; a null id is kept; other columns are not
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import stage, stage_arrow
from .tokens import encoder, with_end

SEQUENCE = 2048
BROADCAST_PLACES = 200_000
RANKS = 1 << 20


# -- packing of a histogram -------------------------------------------------


class _Lengths:
    """Open lengths in ascending order with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {x: c for x, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, x: int, k: int) -> None:
        self.n[x] -= k
        if not self.n[x]:
            del self.n[x]
            self.order.pop(bisect_left(self.order, x))

    def largest(self, room: int, without: dict[int, int]) -> int | None:
        """Largest length up to ``room`` that is left when ``without`` is taken."""
        i = bisect_left(self.order, room + 1) - 1
        while i >= 0:
            x = self.order[i]
            if self.n[x] > without.get(x, 0):
                return x
            i -= 1
        return None

    def smallest(self, k: int, without: dict[int, int]) -> list[int]:
        """The k smallest pieces left when ``without`` is taken."""
        out: list[int] = []
        for x in self.order:
            out += [x] * min(k - len(out), self.n[x] - without.get(x, 0))
            if len(out) >= k:
                break
        return out


def _best_pair(open_: _Lengths, room: int, without: dict[int, int]) -> int:
    """Largest sum up to ``room`` of two open pieces; 0 if none fit."""
    order, best = open_.order, 0
    i, j = 0, bisect_left(order, room) - 1
    while i <= j:
        a, b = order[i], order[j]
        if a + b > room:
            j -= 1
            continue
        na, nb = open_.n[a] - without.get(a, 0), open_.n[b] - without.get(b, 0)
        if (na > 0 and nb > 0 and a != b) or (a == b and na > 1):
            best = max(best, a + b)
            if best == room:
                break
        i += 1
    return best


def reduce_instance(counts: dict[int, int], size: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Sequences fixed by dominance, as (how many, lengths), and what is left."""
    open_, fixed = _Lengths(counts), []
    i = len(open_.order) - 1
    while i >= 0:
        i = min(i, len(open_.order) - 1)
        if i < 0:
            break
        j = open_.order[i]
        own = {j: 1}
        room = size - j
        first = open_.largest(room, own)
        if first is None:
            k = open_.n[j]
            open_.take(j, k)
            fixed.append((k, (j,)))
            i -= 1
            continue
        low = open_.smallest(3, own)
        only_single = len(low) < 2 or low[0] + low[1] > room
        no_triple = len(low) < 3 or sum(low) > room
        dominating = first == room or only_single or (no_triple and first >= _best_pair(open_, room, own))
        if dominating:
            k = open_.n[j] // 2 if first == j else min(open_.n[j], open_.n[first])
            if first != room and not only_single:
                k = 1  # the bound on pairs holds for this instance only
            open_.take(j, 2 * k if first == j else k)
            if first != j:
                open_.take(first, k)
            fixed.append((k, (j, first)))
            i = bisect_left(open_.order, j + 1) - 1
        else:
            i -= 1
    return fixed, dict(open_.n)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on counts: (how many sequences, lengths) groups."""
    groups: dict[int, list[list]] = {}  # room left -> [count, lengths]
    rooms: list[int] = []

    def put(room: int, k: int, lengths: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([k, lengths])

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                per = size // x
                if n >= per:
                    put(size - per * x, n // per, (x,) * per)
                if n % per:
                    put(size - n % per * x, 1, (x,) * (n % per))
                break
            room = rooms[at]
            k, lengths = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            m = min(room // x, n)  # as many as fit, for that sequence stays the best fit
            whole = min(k, n // m)
            if whole < k:
                put(room, k - whole, lengths)
            put(room - m * x, whole, lengths + (x,) * m)
            n -= whole * m
    return [(k, lengths) for r in rooms for k, lengths in groups[r]]


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many sequences, lengths) that pack the whole histogram."""
    fixed, rest = reduce_instance(counts, size)
    return fixed + best_fit(rest, size)


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence of rank_from, offset) rows.

    At most one row per pattern and place in it: their number depends on the
    distinct lengths, not on the number of pieces.
    """
    used: dict[int, int] = {}
    rows, seq = [], 0
    for k, lengths in patterns:
        offset = 0
        for x in lengths:
            r = used.get(x, 0)
            rows.append((x, r, r + k, seq, offset))
            used[x] = r + k
            offset += x
        seq += k
    return rows


# -- Spark ------------------------------------------------------------------


def _pieces(tokenizer: str, size: int, separator: int):
    def run(batches):
        enc = encoder(tokenizer)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs = batch.column(0)
            for i, n, ids in enc.encode_column(batch.column(1)):
                ids, at = with_end(n, ids, separator)
                ids = ids.astype("<u4")
                out = ([], [], [], [], [])
                for doc, a, b in zip(docs.slice(i, len(n)).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    start, length, piece = 0, b - a - (b - a - 1) // size * size, 0
                    while start < b - a:
                        crc = zlib.crc32(ids[a + start : a + start + length])
                        for col, v in zip(out, (doc, piece, start, length, crc), strict=True):
                            col.append(v)
                        start, length, piece = start + length, size, piece + 1
                rows = range(row, row + len(out[0]))
                row += len(rows)
                cols = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(out)]
                cols += [pa.array([task] * len(rows), pa.int32()), pa.array(rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "row"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = SEQUENCE,
    separator: int = 0,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    spec = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, row bigint"
    pieces = stage_arrow(src, _pieces(tokenizer, size, separator), spec, "pieces")
    per_task = stage(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "histogram")
    # One row per length, at most ``size`` of them.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = places(plan(counts, size))
    spark = docs.sparkSession
    slots = spark.createDataFrame(
        rows or [(0, 0, 1, 0, 0)], "len bigint, rank_from bigint, rank_to bigint, seq_from bigint, offset bigint"
    )
    before = per_task.select(
        F.col("task").alias("t"),
        F.col("length").alias("l"),
        F.coalesce(
            F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("task", "length").orderBy("row")) - 1
    ranked = (
        pieces.withColumn("own", own)
        .join(before, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
        .withColumn("rank", F.col("own") + F.col("before"))
    )
    # Places are met by length and stretch of ranks, so a shuffle would spread a
    # frequent length; they depend on the distinct lengths, and while they are
    # few they are broadcast.
    stretch = (F.col("rank") / RANKS).cast("bigint")
    slots = slots.withColumn(
        "part", F.explode(F.sequence(F.floor(F.col("rank_from") / RANKS), F.floor((F.col("rank_to") - 1) / RANKS)))
    )
    slots = F.broadcast(slots) if len(rows) <= BROADCAST_PLACES else slots
    return ranked.join(
        slots,
        (F.col("length") == F.col("len"))
        & (stretch == F.col("part"))
        & (F.col("rank") >= F.col("rank_from"))
        & (F.col("rank") < F.col("rank_to")),
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
        "offset",
    )
