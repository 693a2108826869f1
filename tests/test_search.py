import random

import pytest

from tessera.operators import index, search, telemetry
from tessera.params import SearchParams
from tessera.sources.index_store import Index, read_binary, write_binary

DIM = 14
COLS = [f"q{i}" for i in range(DIM)]
SCHEMA = "ref_id bigint, tag int, label int, " + ", ".join(f"{c} int" for c in COLS)


def vectors(n, seed, step=2000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        q = [rnd.randrange(0, 10001, step) for _ in range(DIM)]
        q[11] = rnd.choice([0, 10000])
        q[5] = rnd.choice([-10000, 0, 4000])
        rows.append((i, (2 if q[11] > 0 else 0) + (q[5] >= 0), rnd.randrange(2), *q))
    return rows


def sequential(query, records, clusters, p):
    """The search as a loop: one cluster after another, a shrinking bound."""
    qid, tag, q = query
    own = [c for c in clusters if c["tag"] == tag]
    def bound(c):
        return sum(max(x - c[f"mx{i}"], c[f"mn{i}"] - x, 0) ** 2 for i, x in enumerate(q))
    order = sorted(own, key=lambda c: (bound(c), c["cluster_id"]))
    top, probed, scanned, early = [], 0, 0, 0
    def scan(rank):
        nonlocal probed, scanned
        c = order[rank]
        probed += 1
        scanned += c["n"]
        for r in records.get((tag, c["cluster_id"]), []):
            if r[0] != qid:
                top.append((sum((a - b) ** 2 for a, b in zip(q, r[3:17])), rank, r[0], r[2]))
        top.sort()
        del top[p.k:]
    def kth():
        return top[-1][0] if len(top) == p.k else 1e20
    for rank in range(min(p.nprobe, len(order))):
        if bound(order[rank]) >= kth():
            break
        scan(rank)
        if top and top[0][0] < p.early_exit:
            early = 1
            break
    repair = int(1 <= sum(t[3] for t in top) <= p.k - 1)
    for rank in range(p.nprobe, len(order)) if repair else ():
        if bound(order[rank]) >= kth():
            break
        scan(rank)
        if top and top[0][0] < p.early_exit:
            early = 1
            break
    score = float(top[0][3]) if top and top[0][0] < p.early_exit else sum(t[3] for t in top) / p.k
    return score, probed, scanned, repair, early, sum(t[0] for t in top), sum(t[2] for t in top)


@pytest.mark.parametrize("seed,n,early", [(1, 160, 10000), (2, 160, 30_000_000), (3, 12, 10000)])
def test_probe_equals_sequential_search(spark, seed, n, early):
    p = SearchParams(nprobe=2, early_exit=early, clusters=6)
    rows = vectors(n, seed)
    records = spark.createDataFrame(rows, SCHEMA)
    ix = Index.build(records, DIM, p)
    assigned = [tuple(r) for r in ix.records.select("ref_id", "tag", "label", *COLS, "cluster_id").collect()]
    by = {}
    for r in sorted(assigned):
        by.setdefault((r[1], r[-1]), []).append(r)
    clusters = [r.asDict() for r in ix.clusters.collect()]
    got = search.probe(records.withColumnRenamed("ref_id", "qid").drop("label"), ix.clusters, ix.records, DIM, p, not_self=True).collect()
    assert len(got) == n
    for g in got:
        r = rows[g["qid"]]
        want = sequential((r[0], r[1], r[3:]), by, clusters, p)
        assert (g["score"], g["clusters_probed"], g["vectors_scanned"], g["repair_triggered"], g["early_exit_taken"], g["sum_dist"], g["sum_id"]) == want


def test_unbounded_probe_is_exact_and_missing_partition(spark):
    p = SearchParams(nprobe=50, early_exit=0, clusters=5)
    rows = [r for r in vectors(120, 7, 1) if r[1] != 0]
    records = spark.createDataFrame(rows, SCHEMA)
    ix = Index.build(records, DIM, p)
    odd = (1000, 0, *([0] * 5), -10000, *([0] * 8))
    q = records.withColumnRenamed("ref_id", "qid").drop("label").union(spark.createDataFrame([odd], records.withColumnRenamed("ref_id", "qid").drop("label").schema))
    a = {r["qid"]: r for r in search.probe(q, ix.clusters, ix.records, DIM, p).collect()}
    b = {r["qid"]: r for r in search.vote(q, search.exact_neighbours(q, records, DIM, p, same_tag=True), p).collect()}
    assert a[1000]["score"] == 0.0 and a[1000]["approved"] and b[1000]["score"] == 0.0
    assert all(a[k]["sum_dist"] == b[k]["sum_dist"] and a[k]["score"] == b[k]["score"] for k in b if k != 1000)


def test_binary_and_parquet_round_trip(spark, tmp_path):
    records = spark.createDataFrame(vectors(60, 4), SCHEMA)
    ix = Index.build(records, DIM, SearchParams(clusters=4))
    ix.save(f"file://{tmp_path}/pq")
    back = Index.load(spark, f"file://{tmp_path}/pq", DIM)
    keep = ["tag", "cluster_id", "label", *COLS]
    want = sorted(map(tuple, ix.records.select(*keep).collect()))
    assert sorted(map(tuple, back.records.select(*keep).collect())) == want
    write_binary(ix, f"{tmp_path}/bin")
    raw = read_binary(spark, f"{tmp_path}/bin", DIM, records_per_task=7)
    assert sorted(map(tuple, raw.records.select(*keep).collect())) == want
    boxes = [c for c in ix.clusters.columns]
    assert sorted(map(tuple, raw.clusters.select(*boxes).collect())) == sorted(map(tuple, ix.clusters.collect()))


def test_percentiles_and_rings(spark):
    rows = [(i + 1, v, v, v, v, v, 1, 1, 0, 1) for i, v in enumerate([1, 2, 3, 10])]
    from tessera.schemas import SAMPLE

    s = spark.createDataFrame(rows, SAMPLE)
    r = telemetry.percentiles(s).where("metric = 'total_ns'").first()
    assert (r["p50_ns"], r["p99_ns"], r["max_ns"]) == (2, 9, 10)
    assert [x["seq"] for x in telemetry.newest(s, 2).orderBy("seq").collect()] == [3, 4]
    due = telemetry.report_points(s, every=2, ring=3).orderBy("seq").collect()
    assert [(x["seq"], x["n"], x["max_ns"]) for x in due] == [(2, 2, 2), (4, 3, 10)]
    assert telemetry.detail(s.where("false")).first()["n"] == 0


def test_kmeans_reaches_a_fixpoint(spark):
    records = spark.createDataFrame(vectors(80, 9, 1), SCHEMA)
    centroids = index.lloyd(records, 3, DIM, 12)
    assert centroids.count() <= 12
    assert index.kmeans(records, 3, DIM, rounds=5).count() <= 12


@pytest.mark.parametrize("seed,n,early,nprobe,not_self", [(1, 160, 10000, 2, True), (2, 160, 30_000_000, 2, True), (3, 12, 10000, 2, False), (5, 200, 5_000_000, 3, False), (6, 200, 40_000_000, 1, True)])
def test_queries_and_records_meet_by_cluster(spark, seed, n, early, nprobe, not_self):
    """More queries than go to the tasks: the same rows, from one scan of the records a round."""
    few = SearchParams(nprobe=nprobe, early_exit=early, clusters=6)
    many = SearchParams(nprobe=nprobe, early_exit=early, clusters=6, probe_block=1, piece=5, lane=7)
    records = spark.createDataFrame(vectors(n, seed), SCHEMA)
    ix = Index.build(records, DIM, few)
    odd = spark.createDataFrame([(n + 5, 9, *([0] * DIM))], "qid bigint, tag int, " + ", ".join(f"{c} int" for c in COLS))
    q = records.withColumnRenamed("ref_id", "qid").drop("label").union(odd)
    found = [search.probe(q, ix.clusters, ix.records, DIM, p, not_self=not_self) for p in (few, many)]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect()))
    assert found[1].count() == n + 1


def test_probe_scans_records_for_rounds_not_for_blocks(spark, monkeypatch):
    scans, mapped = [], search._scan_probes
    monkeypatch.setattr(search, "_scan_probes", lambda *a: scans.append(1) or mapped(*a))
    records = spark.createDataFrame(vectors(60, 1), SCHEMA)
    p = SearchParams(nprobe=2, clusters=6, probe_block=8)
    ix = Index.build(records, DIM, p)
    assert search.probe(records.withColumnRenamed("ref_id", "qid").drop("label"), ix.clusters, ix.records, DIM, p).count() == 60
    assert len(scans) <= 2
