"""Nearest-neighbour search: exact, and by probing clusters with repair.

Records stay where they are: a block of queries (``SearchParams.block`` rows at
most) goes to the tasks, which hold it against their records by matrix products
and send the best few of each query.  All distances are exact integers, compared
in single precision; every order ends in a unique key, so results don't depend on
partitioning.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import SearchParams
from ..runtime import ship, stage
from . import kernels
from .index import by_tag

INF = 1e20


def decision(labels: Column, d1: Column, first_label: Column, p: SearchParams) -> Column:
    """The vote; a very close neighbour decides alone.  Unfilled places count as 0."""
    return F.when(d1 < p.early_exit, first_label.cast("double")).otherwise(F.coalesce(labels, F.lit(0)) / F.lit(float(p.k)))


def _top(df: DataFrame, k: int, order: list) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def _blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """``queries`` in parts of about ``size`` rows, by hash of the id."""
    n = max(1, -(-queries.count() // size))
    return [queries if n == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b) for b in range(n)]


def _scan_all(ids: np.ndarray, tags: np.ndarray, q: np.ndarray, dim: int, k: int, same_tag: bool, not_self: bool):
    """Per task, the ``k`` nearest of its records to every query."""
    names = ["qid", "ref_id", "label", "dist"]

    def run(batches):
        wide = q.astype(np.float64)
        bound = np.full(len(ids), np.finfo(np.float32).max, np.float32)
        held: list[list[np.ndarray]] = []

        def best():
            row, ref, label, d = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ref, d.astype(np.float32), row))
            row, ref, label, d = row[order], ref[order], label[order], d[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
            bound[row[last]] = d[last].astype(np.float32)
            held[:] = [[row[keep], ref[keep], label[keep], d[keep]]]

        for part in kernels.chunks(batches):
            refs, rtags, labels, r = kernels.column(part, "ref_id"), kernels.column(part, "tag"), kernels.column(part, "label"), kernels.matrix(part, dim)
            for a in range(0, len(ids), kernels.QUERIES):
                d = kernels.squared(wide[a : a + kernels.QUERIES], r)
                if same_tag:
                    d[tags[a : a + kernels.QUERIES, None] != rtags] = np.inf
                if not_self:
                    d[ids[a : a + kernels.QUERIES, None] == refs] = np.inf
                row, col = kernels.nearest(d, refs, k, bound[a : a + kernels.QUERIES])
                held.append([row + a, refs[col], labels[col], d[row, col].astype(np.int64)])
            best()
        if held:
            row, *rest = held[0]
            yield from pa.Table.from_arrays([pa.array(ids[row]), *(pa.array(x) for x in rest)], names).to_batches(1 << 16)

    return run


def exact_neighbours(queries: DataFrame, records: DataFrame, dim: int, p: SearchParams, same_tag: bool = False, not_self: bool = False) -> DataFrame:
    """(qid, ref_id, label, dist, rn) of the k nearest records of every query.

    ``not_self`` is for queries that are records themselves: a record is then no
    neighbour of the query with its number.  The shuffle carries k rows per query
    and task.
    """
    ship(records.sparkSession)
    qs = kernels.codes(records, dim)
    found = []
    for part in _blocks(queries, p.block):
        q = part.select("qid", "tag", *kernels.codes(queries, dim)).toArrow()  # one block
        ids, tags, codes = kernels.column(q, "qid"), kernels.column(q, "tag"), kernels.matrix(q, dim).astype(np.int16)
        scan = _scan_all(ids, tags, codes, dim, p.k, same_tag, not_self)
        found.append(records.select("ref_id", "tag", "label", *qs).mapInArrow(scan, "qid bigint, ref_id bigint, label int, dist bigint"))
    return _top(reduce(DataFrame.unionByName, found), p.k, [F.col("dist").cast("float"), F.col("ref_id")])


def vote(queries: DataFrame, neighbours: DataFrame, p: SearchParams) -> DataFrame:
    """One row per query: score, approved, and sums that identify the neighbours."""
    per = neighbours.groupBy("qid").agg(
        F.sum("label").alias("labels"),
        F.min(F.when(F.col("rn") == 1, F.col("dist").cast("float"))).alias("d1"),
        F.min(F.when(F.col("rn") == 1, F.col("label"))).alias("first_label"),
        F.sum("dist").alias("sum_dist"),
        F.sum("ref_id").alias("sum_id"),
    )
    out = queries.select("qid", "tag").join(per, "qid", "left")
    score = F.coalesce(decision(F.col("labels"), F.col("d1"), F.col("first_label"), p), F.lit(0.0))
    return out.select("qid", "tag", score.alias("score"), (score < p.approve_below).alias("approved"), "sum_dist", "sum_id")


def _bounds(part: pa.Table, known: dict[int, tuple], dim: int, q: str = "q"):
    """Blocks of a table's rows with the lower bounds of their tag's clusters: (rows, tag, bounds)."""
    tags, q = kernels.column(part, "tag"), kernels.matrix(part, dim, q)
    for t in np.unique(tags).tolist():
        if t in known:
            own, low, high = np.flatnonzero(tags == t), known[t][1], known[t][2]
            for a in range(0, len(own), kernels.BOUNDS):
                at = own[a : a + kernels.BOUNDS]
                yield at, t, kernels.box_bounds(q[at], low, high).astype(np.float32)


def _ranks(known: dict[int, tuple], dim: int, upto: int | None):
    """Clusters of each query's tag by (lower bound, number), the first ``upto`` of them."""

    def run(batches):
        for part in kernels.chunks(batches, kernels.QUERIES):
            ids = kernels.column(part, "qid")
            for at, t, lb in _bounds(part, known, dim):
                number, n = known[t][0], known[t][3]
                row, c = kernels.nearest(lb, np.arange(lb.shape[1]), upto or lb.shape[1])
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                cols = [ids[at][row], np.full(len(row), t, np.int32), number[c], n[c], lb[row, c], rank.astype(np.int32)]
                names = ["qid", "tag", "cluster_id", "n", "lb", "rank"]
                yield from pa.Table.from_arrays([pa.array(x) for x in cols], names).to_batches(1 << 16)

    return run


def _lists(known: dict[int, tuple], dim: int, begin: int, upto: int | None):
    """Per query the clusters of its tag from rank ``begin`` on, as lists of numbers, sizes and
    bounds in order: up to rank ``upto``, or those nearer than its ``kth``, where one that
    was ended by a very close neighbour (``hit``) reads one at most."""

    def run(batches):
        for part in kernels.chunks(batches, kernels.QUERIES):
            whole = part.num_rows
            hit = kth = None
            if upto is None:
                hit, kth = part.column("hit").is_valid().to_numpy(), kernels.column(part, "kth")
            found = []
            for at, t, lb in _bounds(part, known, dim, "code"):
                if upto is None:
                    row, c = np.nonzero(lb < kth[at, None])
                    order = np.lexsort((c, lb[row, c], row))
                    row, c = row[order], c[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = (rank >= begin) & (~hit[at][row] | (rank == begin))
                    row, c = row[keep], c[keep]
                else:
                    row, c = kernels.nearest(lb, np.arange(lb.shape[1]), upto)
                found.append((at[row], known[t][0][c], known[t][3][c], lb[row, c]))
            empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32))
            of, number, n, lb = (np.concatenate(x) for x in zip(empty, *found, strict=True))
            order = np.argsort(of, kind="stable")
            ends = pa.array(np.searchsorted(of[order], np.arange(whole + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (number, n, lb)]
            cols = [part.column("qid").combine_chunks(), part.column("tag").combine_chunks(), part.column("code").combine_chunks(), *lists]
            yield from pa.Table.from_arrays(cols, ["qid", "tag", "code", "cells", "sizes", "lbs"]).to_batches(1 << 12)

    return run


_RANKED = "qid bigint, tag int, cluster_id int, n bigint, lb float, rank int"
_LISTED = "qid bigint, tag int, code array<smallint>, cells array<int>, sizes array<bigint>, lbs array<float>"


def rank_clusters(queries: DataFrame, clusters: DataFrame, dim: int, upto: int | None = None) -> DataFrame:
    """(qid, tag, cluster_id, n, lb, rank): clusters of the query's tag by lower
    bound, the first ``upto`` if given.

    The cluster table (clusters x tags rows, bounded by the parameters) goes to
    the tasks; queries stay where they are.
    """
    ship(queries.sparkSession)
    known = by_tag(clusters, dim, "mn", "mx", "n")
    return queries.select("qid", "tag", *kernels.codes(queries, dim)).mapInArrow(_ranks(known, dim, upto), _RANKED)


def _scan_probes(probes: pa.Table, ids: np.ndarray, q: np.ndarray, dim: int, k: int, not_self: bool):
    """Per task, the ``k`` nearest of its records in each probed cluster of a query.

    The best of each rank suffice: what is among the best over several ranks is
    so in its own.
    """
    of = np.searchsorted(ids, kernels.column(probes, "qid"))
    cell = kernels.column(probes, "tag").astype(np.int64) << 32 | kernels.column(probes, "cluster_id")
    order = np.argsort(cell, kind="stable")
    cell, of, rank = cell[order], of[order], kernels.column(probes, "rank")[order]
    names = ["qid", "rank", "ref_id", "label", "dist", "d"]

    def run(batches):
        wide = q.astype(np.float64)
        for part in kernels.chunks(batches, 16 * kernels.RECORDS):
            refs, labels, r = kernels.column(part, "ref_id"), kernels.column(part, "label"), kernels.matrix(part, dim)
            cells = kernels.column(part, "tag").astype(np.int64) << 32 | kernels.column(part, "cluster_id")
            by_cell = np.argsort(cells, kind="stable")
            known, begin = np.unique(cells[by_cell], return_index=True)
            lows, highs = np.searchsorted(cell, known), np.searchsorted(cell, known + 1)
            found = []
            for i in np.flatnonzero(highs > lows):
                lo, hi = lows[i], highs[i]
                at = by_cell[begin[i] : begin[i + 1] if i + 1 < len(begin) else len(by_cell)]
                for a in range(lo, hi, kernels.QUERIES):
                    mine = of[a : min(hi, a + kernels.QUERIES)]
                    d = kernels.squared(wide[mine], r[at])
                    if not_self:
                        d[ids[mine, None] == refs[at]] = np.inf
                    row, col = kernels.nearest(d, refs[at], k)
                    dist = d[row, col].astype(np.int64)
                    found.append((ids[mine[row]], rank[a + row], refs[at[col]], labels[at[col]], dist, dist.astype(np.float32)))
            if found:
                cols = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield from pa.Table.from_arrays(cols, names).to_batches(1 << 16)

    return run


_FOUND = "qid bigint, rank int, ref_id bigint, label int, dist bigint, d float"


def _candidates(listed: DataFrame, probes: DataFrame, records: DataFrame, dim: int, k: int, not_self: bool) -> DataFrame:
    """``_FOUND`` of the best records of every probe, for one block of queries that goes to the tasks."""
    q = listed.select("qid", "code").toArrow().sort_by("qid")  # one block
    asked = probes.select("qid", "tag", "cluster_id", "rank").toArrow()  # its probes
    scan = _scan_probes(asked, kernels.column(q, "qid"), kernels.matrix(q, dim, "code").astype(np.int16), dim, k, not_self)
    return records.select("ref_id", "tag", "label", "cluster_id", *kernels.codes(records, dim)).mapInArrow(scan, _FOUND)


def _scan_pieces(dim: int, k: int, not_self: bool):
    """Rows in the order of pieces, a piece's records before its probes: per probe, the
    ``k`` nearest of the piece's records that are nearer than the probe's ``kth``."""
    names = ["qid", "rank", "ref_id", "label", "dist", "d"]
    more = k + not_self  # the query itself may be among them

    def run(batches):
        current, held, r = None, [], None
        for part in kernels.chunks(batches, kernels.ROWS):
            ids, labels, ranks, kths = (kernels.column(part, c) for c in ("id", "label", "rank", "kth"))
            kind, q = kernels.column(part, "kind"), kernels.matrix(part, dim, "code")
            keys = np.stack([kernels.column(part, c) for c in ("tag", "cluster_id", "piece", "lane")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])) + 1
            found = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                key = tuple(keys[:, lo].tolist())
                if key != current:
                    current, held, r = key, [], None
                if kind[lo] == 0:
                    held.append((ids[lo:hi], labels[lo:hi], q[lo:hi]))
                    r = None
                    continue
                if not held:
                    continue
                if r is None:
                    refs, own, r = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, r = [(refs, own, r)], kernels.beside(r)
                step = max(1, kernels.CELLS // len(refs))
                for a in range(lo, hi, step):
                    b = min(hi, a + step)
                    d = kernels.before(q[a:b]) @ r
                    row, col = kernels.nearer(d, refs, more, kths[a:b])
                    if not_self:
                        row, col = kernels.first_of(*(x[ids[a:b][row] != refs[col]] for x in (row, col)), k)
                    dist = d[row, col].astype(np.int64)
                    found.append((ids[a:b][row], ranks[a:b][row], refs[col], own[col], dist, dist.astype(np.float32)))
            if found:
                cols = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield from pa.Table.from_arrays(cols, names).to_batches(1 << 16)

    return run


def _dealt(probes: DataFrame, records: DataFrame, dim: int, k: int, not_self: bool, p: SearchParams) -> DataFrame:
    """``_candidates`` of any number of queries: probes and records meet by cluster, in one shuffle.

    A cluster's records are cut into pieces and its probes into lanes of bounded size, so
    none is the work of one task; a probe goes to all pieces of its cluster, a record to
    all lanes.  The table of cuts has clusters x tags rows, which the parameters bound.
    """
    cell = ["tag", "cluster_id"]
    asked = probes.groupBy(*cell).agg(F.ceil(F.count("*") / p.lane).cast("int").alias("lanes"))
    sizes = records.groupBy(*cell).agg(F.ceil(F.count("*") / p.piece).cast("int").alias("pieces"))
    cuts = F.broadcast(stage(asked.join(sizes, cell), "cuts"))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    code = kernels.codes(records, dim)
    code = (F.array(*code) if len(code) > 1 else F.col(code[0])).cast("array<smallint>")
    held = records.select(*cell, F.col("ref_id").alias("id"), "label", code.alias("code")).join(cuts, cell)
    held = held.select(*cell, part("id", "pieces").alias("piece"), spread("lanes").alias("lane"), F.lit(0).alias("kind"), "id", "label",
                       F.lit(0).alias("rank"), F.lit(0).cast("float").alias("kth"), "code")
    sought = probes.select(*cell, F.col("qid").alias("id"), "rank", "kth", "code").join(cuts, cell)
    sought = sought.select(*cell, spread("pieces").alias("piece"), part("id", "lanes").alias("lane"), F.lit(1).alias("kind"), "id", F.lit(0).alias("label"),
                           "rank", "kth", "code")
    order = [*cell, "piece", "lane"]
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.unionByName(sought).repartition(n, *order).sortWithinPartitions(*order, "kind").mapInArrow(_scan_pieces(dim, k, not_self), _FOUND)


_TOP = "array<struct<d:float,rank:int,ref_id:bigint,label:int,dist:bigint>>"


def _tops(cand: DataFrame, p: SearchParams, top: str, hit: str) -> DataFrame:
    """Per query, the k best candidates as an array, up to the first rank that holds a very
    close neighbour, and that rank."""
    rows = F.sort_array(F.collect_list(F.struct("d", "rank", "ref_id", "label", "dist"))).alias("all")
    per = cand.groupBy("qid").agg(rows, F.min(F.when(F.col("d") < p.early_exit, F.col("rank"))).alias(hit))
    read = F.filter("all", lambda x: F.col(hit).isNull() | (x["rank"] <= F.col(hit)))
    return per.select("qid", F.slice(read, 1, p.k).cast(_TOP).alias(top), hit)


def _best(k: int, *tops: str) -> Column:
    none = F.array().cast(_TOP)
    return F.slice(F.sort_array(F.concat(*[F.coalesce(t, none) for t in tops])), 1, k)


def _kth(k: int, top: str) -> Column:
    return F.when(F.size(top) == k, F.element_at(top, -1)["d"]).otherwise(F.lit(INF).cast("float"))


def _frauds(top: str) -> Column:
    return F.aggregate(F.transform(top, lambda x: x["label"]), F.lit(0), lambda a, x: a + x)


def _scanned(kth: str, top: str, lb: Column, rank: Column) -> Column:
    """Whether a sequential scan with a shrinking bound would have read this rank."""
    deepest = F.array_max(F.transform(top, lambda x: x["rank"]))
    return (lb < F.col(kth)) | ((lb == F.col(kth)) & (deepest >= rank))


def _probes(listed: DataFrame, begin: int) -> DataFrame:
    """A row for each cluster in the lists, whose first has rank ``begin``."""
    rows = listed.select("qid", "tag", "code", "kth", F.posexplode(F.arrays_zip("cells", "lbs")).alias("at", "x"))
    return rows.select("qid", "tag", "code", "kth", (F.col("at") + begin).alias("rank"), F.col("x.cells").alias("cluster_id"), F.col("x.lbs").alias("lb"))


def probe(queries: DataFrame, clusters: DataFrame, records: DataFrame, dim: int, p: SearchParams, repair: bool = True, not_self: bool = False) -> DataFrame:
    """Search by ``p.nprobe`` clusters, then repair of ambiguous votes.

    Returns one row per query: score, approved, clusters_probed,
    vectors_scanned, repair_triggered, early_exit_taken, sum_dist, sum_id.
    ``qid`` must be unique; ``not_self`` is as in ``exact_neighbours``.

    Up to ``p.probe_block`` queries go to the tasks that hold the records.  More meet
    the records by cluster, the nearest cluster first: the others are read only where
    their bound is below the fifth distance found there.
    """
    ship(records.sparkSession)
    known, wide = by_tag(clusters, dim, "mn", "mx", "n"), kernels.codes(queries, dim)
    code = (F.array(*wide) if len(wide) > 1 else F.col(wide[0])).cast("array<smallint>").alias("code")
    listed = stage(queries.select("qid", "tag", code).mapInArrow(_lists(known, dim, 0, p.nprobe), _LISTED), "listed")
    few = listed.count() <= p.probe_block

    def scan(of: DataFrame, probes: DataFrame) -> DataFrame:
        return _candidates(of, probes, records, dim, p.k, not_self) if few else _dealt(probes, records, dim, p.k, not_self, p)

    first = _probes(listed.withColumn("kth", F.lit(INF).cast("float")), 0)
    near = _tops(scan(listed, first if few else first.where("rank = 0")), p, "top", "hit")
    state = listed.join(near, "qid", "left").withColumn("top", _best(p.k, "top")).withColumn("kth", _kth(p.k, "top"))
    if not few:
        state = stage(state, "nearest")
        asked = stage(_probes(state.where("hit IS NULL"), 0).where("rank > 0 AND lb < kth"), "asked")
        near = _tops(scan(state, asked), p, "top1", "hit1")
        state = state.join(near, "qid", "left").withColumn("top", _best(p.k, "top", "top1")).withColumn("hit", F.coalesce("hit", "hit1")).drop("top1", "hit1")
        state = state.withColumn("kth", _kth(p.k, "top"))
    state = state.withColumn("repair", _frauds("top").between(1, p.k - 1) if repair else F.lit(False))
    state = stage(state, "stage1")  # read several times below, and the second round must not run the first again
    none = {"cells2": "array<int>", "sizes2": "array<bigint>", "lbs2": "array<float>", "top2": _TOP, "hit2": "int"}
    if repair:
        open_ = state.where("repair").select("qid", "tag", "code", "kth", "hit")
        # after an early exit the scan resumes at the first unread rank and stops there
        more = stage(open_.mapInArrow(_lists(known, dim, p.nprobe, None), _LISTED), "more")
        asked = _probes(more.join(open_.select("qid", "kth"), "qid"), p.nprobe)
        asked = asked if few else stage(asked, "asked")
        further = more.select("qid", *[F.col(c).alias(f"{c}2") for c in ("cells", "sizes", "lbs")])
        final = state.join(further, "qid", "left").join(_tops(scan(more, asked), p, "top2", "hit2"), "qid", "left")
    else:
        final = state.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    final = final.withColumn("best", _best(p.k, "top", "top2")).withColumn("kth2", _kth(p.k, "best"))
    final = stage(final, "final") if repair else final
    hit, hit2 = F.col("hit"), F.col("hit2")
    read1 = F.filter(F.arrays_zip("sizes", "lbs"), lambda x, i: (hit.isNull() | (i <= hit)) & _scanned("kth", "top", x["lbs"], i))
    read2 = F.filter(
        F.arrays_zip(F.col("sizes2").alias("sizes"), F.col("lbs2").alias("lbs")),
        lambda x, i: (hit2.isNull() | (i + p.nprobe <= hit2)) & (_scanned("kth2", "best", x["lbs"], i + p.nprobe) | hit.isNotNull()),
    )
    zero = F.lit(0).cast("bigint")
    sizes = F.concat(F.transform(read1, lambda x: x["sizes"]), F.coalesce(F.transform(read2, lambda x: x["sizes"]), F.array().cast("array<bigint>")))
    final = final.withColumn("read", sizes)
    head = F.when(F.size("best") > 0, F.element_at("best", 1))
    score = F.coalesce(decision(_frauds("best"), head["d"], head["label"], p), F.lit(0.0))
    return final.select(
        "qid",
        "tag",
        score.alias("score"),
        (score < p.approve_below).alias("approved"),
        F.size("read").cast("bigint").alias("clusters_probed"),
        F.aggregate("read", zero, lambda a, x: a + x).alias("vectors_scanned"),
        F.col("repair").cast("int").alias("repair_triggered"),
        F.coalesce(head["d"] < p.early_exit, F.lit(False)).cast("int").alias("early_exit_taken"),
        F.aggregate(F.transform("best", lambda x: x["dist"]), zero, lambda a, x: a + x).alias("sum_dist"),
        F.aggregate(F.transform("best", lambda x: x["ref_id"]), zero, lambda a, x: a + x).alias("sum_id"),
    )
