import json

from tests.test_scalar import SAMPLE
from tests.test_search import COLS, DIM, SCHEMA, vectors

from tessera.operators import vectorize
from tessera.params import SearchParams
from tessera.schemas import SAMPLE as SAMPLES
from tessera.sources import requests as R
from tessera.sources.index_store import Index
from tessera.streaming.score import report_stream, score_batch, score_stream, serve


def brute(body, records, p):
    """Exact search of one request by hand, in its partition."""
    q, tag = body
    near = sorted((sum((a - b) ** 2 for a, b in zip(q, r[3:17])), r[0], r[2]) for r in records if r[1] == tag)[: p.k]
    if not near:
        return 0.0
    return float(near[0][2]) if near[0][0] < p.early_exit else sum(n[2] for n in near) / p.k


def test_request_ids_are_data(spark):
    """Scores don't depend on ids: names, null, repeated ones, and numbers of reference records."""
    rows = vectors(80, 3)
    ix = Index.build(spark.createDataFrame(rows, SCHEMA), DIM, SearchParams(clusters=4))
    p = SearchParams(nprobe=4, clusters=4)
    ids = ["tx-1", None, "5", "32", "tx-1", "900001", "tx-1"]
    bodies = [json.dumps(SAMPLE | {"id": i}) for i in ids] + ["broken", None, "{}"]
    df = spark.createDataFrame([(k, b, "mine") for k, b in enumerate(bodies)], "n int, body string, note string").repartition(3)
    got = {r["n"]: r for r in score_batch(df, ix, p).collect()}
    assert len(got) == 10 and [got[k]["id"] for k in range(7)] == ids and got[0]["note"] == "mine"
    one = vectorize.quantized(vectorize.features(R.parse(df.where("n = 0")))).first()
    want = brute(([one[c] for c in COLS], one["tag"]), rows, p)
    assert {got[k]["score"] for k in range(7)} == {want} and {got[k]["status"] for k in range(7)} == {200}
    for k in (7, 8, 9):
        assert (got[k]["status"], got[k]["score"], got[k]["response"]) == (400, None, None) and got[k]["answer"].startswith("HTTP/1.1 400 Bad Request\r\n")
    assert score_batch(df.where("false"), ix, p).count() == 0


def test_serve_raw_requests(spark):
    ix = Index.build(spark.createDataFrame(vectors(40, 3), SCHEMA), DIM, SearchParams(clusters=4))
    body = json.dumps(SAMPLE | {"id": "é"}, ensure_ascii=False)
    head = "POST /fraud-score HTTP/1.1\r\nContent-Length: "
    raw = ["GET /ready HTTP/1.1\r\n\r\n", "GET /x HTTP/1.1\r\n\r\n", f"POST /fraud-score HTTP/1.1\r\n\r\n{body}", f"{head}{len(body.encode())}\r\n\r\n{body}",
           f"{head}{len(body.encode()) + 1}\r\n\r\n{body}", f"{head}3\r\n\r\n{body}", "GET /ready", None]
    df = spark.createDataFrame(list(enumerate(raw)), "n int, raw string")
    got = {r["n"]: r for r in serve(df, ix, SearchParams(nprobe=2, clusters=4)).collect()}
    assert [got[k]["status"] for k in range(8)] == [200, 404, 400, 200, None, 400, None, None]
    text = got[3]["answer"]
    assert text.startswith("HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nContent-Length: 3") and text.split("\r\n\r\n")[1].startswith('{"approved":')


def test_stream_equals_batch(spark, tmp_path):
    ix = Index.build(spark.createDataFrame(vectors(80, 3), SCHEMA), DIM, SearchParams(clusters=4))
    p = SearchParams(nprobe=2, clusters=4)
    for k in range(2):
        lines = [json.dumps(SAMPLE | {"id": f"{k}{i}", "customer": SAMPLE["customer"] | {"tx_count_24h": 3 * i}}) for i in range(5)] + ["broken"]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.txt").write_text("\n".join(lines) + "\n")
    score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", ix, p, files_per_trigger=1).awaitTermination()
    def rows(df):
        return sorted((r["id"] or "", r["score"] or 0.0, r["response"] or "", r["status"]) for r in df.collect())
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows(score_batch(R.read_requests(spark, f"{tmp_path}/in").drop("request"), ix, p)) and len(got) == 12
    times = spark.read.parquet(f"{tmp_path}/out.times").collect()
    assert sorted((r["number"], r["rows"]) for r in times) == [(0, 6), (1, 6)] and all(0 < r["search_ns"] + r["write_ns"] <= r["total_ns"] for r in times)


def test_report_stream(spark, tmp_path):
    rows = [(i, i, i, i, i, i, 1, 1, 0, 0) for i in range(1, 51)]
    for k in range(0, 50, 25):
        spark.createDataFrame(rows[k : k + 25], SAMPLES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    report_stream(spark, f"{tmp_path}/in", SAMPLES, f"{tmp_path}/out", f"{tmp_path}/cp", every=10, ring=20).awaitTermination()
    got = sorted((r["seq"], r["n"], r["max_ns"]) for r in spark.read.parquet(f"{tmp_path}/out/reports").collect())
    assert got == [(10, 10, 10), (20, 20, 20), (30, 20, 30), (40, 20, 40), (50, 20, 50)]


def test_gzip_references(spark, tmp_path):
    import gzip

    rows = [{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [0.1] * 13, "label": "legit"}, {"vector": [0.2] * 14, "label": "legit"}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    assert [r["label"] for r in R.read_references(spark, f"{tmp_path}/r.json.gz").orderBy("ref_id").collect()] == [1, 0]
    assert len(COLS) == 14


def test_references_to_index_and_answers(spark, tmp_path):
    """One call from a reference file to an index on disk that scores requests."""
    import gzip

    from tessera.sources.index_store import build_index, read_binary, write_binary

    rows = [{"vector": [x / 10000 if x >= 0 else -1 for x in r[3:17]], "label": "fraud" if r[2] else "legit"} for r in vectors(120, 8)]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows + [{"vector": [1.0], "label": "fraud"}], f)
    p = SearchParams(clusters=5)
    for method in ("kmeans", "lloyd"):
        ix = build_index(spark, f"{tmp_path}/r.json.gz", f"file://{tmp_path}/{method}", p, rounds=4, method=method)
        assert ix.size() == ix.records.count() == 120
        for c in ix.centroids.collect():
            assert all(-10000 <= c[q] <= 10000 for q in COLS)
        # every record is with its nearest stored centroid
        centers = {(c["tag"], c["cluster_id"]): [c[q] for q in COLS] for c in ix.centroids.collect()}
        for r in ix.records.collect():
            d = {c: sum((a - r[q]) ** 2 for a, q in zip(v, COLS)) for (t, c), v in centers.items() if t == r["tag"]}
            assert r["cluster_id"] == min(d, key=lambda c: (d[c], c))
    write_binary(ix, f"file://{tmp_path}/bin")
    raw = read_binary(spark, f"{tmp_path}/bin", DIM)
    df = spark.createDataFrame([(json.dumps(SAMPLE),)], "body string")
    a, b = (score_batch(df, i, SearchParams(nprobe=9)).first() for i in (ix, raw))
    assert a["score"] == b["score"] and a["status"] == 200
    import numpy as np

    stored = np.fromfile(tmp_path / "bin/part3_centroids.bin", "<f4").reshape(-1, 16)
    assert np.allclose(stored[:, :14] * 10000, [v for (t, _), v in sorted(centers.items()) if t == 3], atol=0.01) and not stored[:, 14:].any()
