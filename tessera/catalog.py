"""All queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import evaluate, index, search, telemetry, vectorize
from .params import DIM, MCC_RISK, SearchParams
from .params import EMBEDDING_DIM as D
from .params import EMBEDDING_PARAMS as EP
from .plans import embeddings as E
from .plans import transactions as T
from .runtime import ship, stage
from .sources import requests as R
from .sources import synthetic
from .sources.index_store import Index
from .streaming.score import score_batch, serve

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- pieces shared by the queries and their SQL ------------------------------


def _index(spark: SparkSession, sf_dir: str):
    records = E.records(spark, sf_dir)
    centroids = stage(index.pivots(records, EP.clusters), "centroids")
    assigned = stage(index.assign(records, centroids, D), "assigned")
    return records, centroids, assigned, index.cluster_table(assigned, centroids, D)


def _ivf_sql(views: str, dim: int, p: SearchParams, not_self: bool) -> dict[str, str]:
    """The search as views over ``rec`` (ref_id, tag, label, q*) and ``qry`` (qid, tag, q*), up to each of its steps."""
    distance, bound = (lambda a, b: E.distance_sql(a, b, dim)), (lambda a, b: E.bound_sql(a, b, dim))
    other = " AND r.ref_id <> rk.qid" if not_self else ""
    out = {}
    out["centers"] = f"""
{views},
cen AS (SELECT * EXCLUDE (rn), rn - 1 AS cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ref_id) AS rn FROM rec) WHERE rn <= {p.clusters})
"""
    out["assigned"] = f"""
{out["centers"]},
ad AS (SELECT r.ref_id, c.cluster_id, {distance("r", "c")} AS dist FROM rec r JOIN cen c USING (tag)),
asg AS (SELECT rec.*, x.cluster_id, x.dist FROM rec JOIN
        (SELECT ref_id, cluster_id, dist FROM ad QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY dist, cluster_id) = 1) x USING (ref_id))
"""
    out["boxes"] = f"""
{out["assigned"]},
box0 AS (SELECT tag, cluster_id, count(*) AS n, {", ".join(f"min(q{i}) AS mn{i}, max(q{i}) AS mx{i}" for i in range(dim))} FROM asg GROUP BY tag, cluster_id),
box AS (SELECT cen.tag, cen.cluster_id, coalesce(n, 0) AS n,
        coalesce(CAST(sum(n) OVER (PARTITION BY cen.tag ORDER BY cen.cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset",
        {", ".join(f"coalesce(mn{i}, 32767) AS mn{i}, coalesce(mx{i}, -32768) AS mx{i}" for i in range(dim))}
       FROM cen LEFT JOIN box0 ON cen.tag = box0.tag AND cen.cluster_id = box0.cluster_id)
"""
    out["ranked"] = f"""
{out["boxes"]},
lbs AS (SELECT q.qid, q.tag, c.cluster_id, c.n, CAST({bound("q", "c")} AS FLOAT) AS lb FROM qry q JOIN box c USING (tag)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lb, cluster_id) - 1 AS rank FROM lbs)
"""
    out["ivf"] = f"""
{out["ranked"]},
pairs AS (SELECT rk.qid, rk.rank, rk.lb, r.ref_id, r.label, {distance("q", "r")} AS dist
          FROM rk JOIN qry q ON q.qid = rk.qid JOIN asg r ON r.tag = rk.tag AND r.cluster_id = rk.cluster_id{other}),
cand AS (SELECT *, CAST(dist AS FLOAT) AS d FROM pairs),
h1 AS (SELECT qid, min(rank) AS hit FROM cand WHERE rank < {p.nprobe} AND d < {p.early_exit} GROUP BY qid),
t1 AS (SELECT c.* EXCLUDE (lb), hit FROM cand c LEFT JOIN h1 USING (qid) WHERE rank < {p.nprobe} AND (hit IS NULL OR rank <= hit)
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, rank, ref_id) <= {p.k}),
s1 AS (SELECT q.qid, q.tag, a.hit, coalesce(a.kth, 1e20::FLOAT) AS kth, coalesce(a.frauds, 0) AS frauds, a.deepest
       FROM qry q LEFT JOIN (SELECT qid, max(hit) AS hit, CASE WHEN count(*) = {p.k} THEN max(d) ELSE 1e20::FLOAT END AS kth,
         CAST(sum(label) AS INT) AS frauds, max(rank) AS deepest FROM t1 GROUP BY qid) a ON a.qid = q.qid),
c2 AS (SELECT c.* EXCLUDE (lb) FROM cand c JOIN s1 USING (qid) WHERE frauds BETWEEN 1 AND {p.k - 1} AND rank >= {p.nprobe} AND lb < kth
       AND (hit IS NULL OR rank = {p.nprobe})),
h2 AS (SELECT qid, min(rank) AS hit2 FROM c2 WHERE d < {p.early_exit} GROUP BY qid),
t2 AS (SELECT * FROM (SELECT c2.* FROM c2 LEFT JOIN h2 USING (qid) WHERE hit2 IS NULL OR rank <= hit2
         UNION ALL SELECT * EXCLUDE (hit) FROM t1)
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, rank, ref_id) <= {p.k}),
fin AS (SELECT qid, CASE WHEN count(*) = {p.k} THEN max(d) ELSE 1e20::FLOAT END AS kth2, max(rank) AS deepest2, CAST(sum(label) AS INT) AS frauds2,
         min(d) AS d1, arg_min(label, [CAST(d AS DOUBLE), rank, ref_id]) AS l1, CAST(sum(dist) AS BIGINT) AS sum_dist, CAST(sum(ref_id) AS BIGINT) AS sum_id
        FROM t2 GROUP BY qid),
st AS (SELECT rk.qid, rk.n FROM rk JOIN s1 USING (qid) LEFT JOIN fin USING (qid) LEFT JOIN h2 USING (qid)
 WHERE (rank < {p.nprobe} AND (hit IS NULL OR rank <= hit) AND (lb < kth OR (lb = kth AND deepest >= rank)))
  OR (rank >= {p.nprobe} AND frauds BETWEEN 1 AND {p.k - 1} AND lb < kth AND (hit IS NULL OR rank = {p.nprobe}) AND (hit2 IS NULL OR rank <= hit2)
      AND (hit IS NOT NULL OR lb < kth2 OR (lb = kth2 AND deepest2 >= rank)))),
cn AS (SELECT qid, count(*) AS clusters_probed, CAST(sum(n) AS BIGINT) AS vectors_scanned FROM st GROUP BY qid),
stats AS (SELECT s1.qid, coalesce(clusters_probed, 0) AS clusters_probed, coalesce(vectors_scanned, 0) AS vectors_scanned,
 CAST(frauds BETWEEN 1 AND {p.k - 1} AS INT) AS repair_triggered, CAST(coalesce(d1 < {p.early_exit}, false) AS INT) AS early_exit_taken
 FROM s1 LEFT JOIN fin USING (qid) LEFT JOIN cn USING (qid))
"""
    return out


_STEPS = _ivf_sql(f"{E.RECORDS_SQL}, qry AS (SELECT ref_id AS qid, * EXCLUDE (ref_id, label) FROM rec)", D, EP, True)
_CENTERS, _ASSIGNED, _BOXES, _RANKED, _IVF = (_STEPS[k] for k in ("centers", "assigned", "boxes", "ranked", "ivf"))
_VOTE = "CASE WHEN d1 < {early} THEN CAST(l1 AS DOUBLE) ELSE coalesce(frauds, 0) / 5.0 END"
_PAIRS = f"""
{E.RECORDS_SQL},
near AS (SELECT q.ref_id AS qid, r.ref_id, r.label, {E.distance_sql("q", "r")} AS dist FROM rec q JOIN rec r ON q.ref_id <> r.ref_id),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST(dist AS FLOAT), ref_id) AS rn FROM near QUALIFY rn <= {EP.k}),
exact AS (SELECT qid, CAST(sum(label) AS INT) AS frauds, CAST(min(dist) AS FLOAT) AS d1, max(CASE WHEN rn = 1 THEN label END) AS l1,
          CAST(sum(dist) AS BIGINT) AS sum_dist, CAST(sum(ref_id) AS BIGINT) AS sum_id FROM top GROUP BY qid),
voted AS (SELECT ref_id AS qid, tag, label, coalesce({_VOTE.format(early=EP.early_exit)}, 0) AS score, sum_dist, sum_id FROM rec LEFT JOIN exact ON qid = ref_id)
"""


# -- scalar functions over the tables -----------------------------------------


@query("""SELECT c_custkey, CAST(greatest(0::FLOAT, least(1::FLOAT, CAST(CAST(c_acctbal AS FLOAT) / 10000::FLOAT AS FLOAT))) AS FLOAT) AS scaled FROM customer""")
def clamp_scale(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", S.scaled(F.col("c_acctbal"), 10000.0).alias("scaled"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN greatest(0::FLOAT, least(1::FLOAT,
CAST(CAST(CAST(l_extendedprice AS FLOAT) / CAST(l_quantity AS FLOAT) AS FLOAT) / 2000::FLOAT AS FLOAT))) ELSE 0::FLOAT END AS ratio FROM lineitem""")
def guarded_ratio(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select("l_orderkey", "l_linenumber", S.guarded_ratio(F.col("l_extendedprice"), F.col("l_quantity"), 2000.0).alias("ratio"))


@query(f"WITH {E.RECORDS_SQL} SELECT * FROM rec")
def quantize_vectors(spark, sf_dir):
    return E.unrolled(E.records(spark, sf_dir), "q")


@query(f"WITH {E.RECORDS_SQL} SELECT tag, count(*) AS n FROM rec GROUP BY tag")
def partition_counts(spark, sf_dir):
    return index.partition_counts(E.records(spark, sf_dir))


@query(f"WITH {_CENTERS} SELECT r.ref_id, c.cluster_id, {E.distance_sql('r', 'c')} AS dist FROM rec r JOIN cen c USING (tag)")
def squared_distances(spark, sf_dir):
    records = E.records(spark, sf_dir)
    c = index.pivots(records, EP.clusters)
    return index.distances(records, c, D)


# -- requests and features -----------------------------------------------------

_MCC = ", ".join(f"('{c}', {r}::FLOAT)" for c, r in MCC_RISK.items())


def _clamp(x: str) -> str:
    return f"greatest(0::FLOAT, least(1::FLOAT, CAST({x} AS FLOAT)))"


_FEATURES_SQL = f"""
{T.TX_SQL},
mcc AS (SELECT * FROM (VALUES {_MCC}) AS m(code, risk)),
fe AS (SELECT event_id, label,
  {_clamp("amount / 10000::FLOAT")} AS f0,
  {_clamp("installments / 12::FLOAT")} AS f1,
  CASE WHEN customer_avg > 0 THEN {_clamp("CAST(amount / customer_avg AS FLOAT) / 10::FLOAT")} ELSE 0::FLOAT END AS f2,
  {_clamp("CAST(hour(ts) AS FLOAT) / 23::FLOAT")} AS f3,
  {_clamp("CAST(isodow(ts) - 1 AS FLOAT) / 6::FLOAT")} AS f4,
  CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {_clamp("CAST(abs(CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(last_ts)) AS BIGINT)) AS DOUBLE) / 60.0::DOUBLE / 1440.0::DOUBLE")} END AS f5,
  CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {_clamp("km_from_current / 1000::FLOAT")} END AS f6,
  {_clamp("km_from_home / 1000::FLOAT")} AS f7,
  {_clamp("tx_count_24h / 20::FLOAT")} AS f8,
  CAST(is_online AS FLOAT) AS f9, CAST(card_present AS FLOAT) AS f10,
  CASE WHEN list_contains(known_merchants, merchant_id) THEN 0::FLOAT ELSE 1::FLOAT END AS f11,
  coalesce(risk, 0.5::FLOAT) AS f12,
  {_clamp("merchant_avg / 10000::FLOAT")} AS f13
 FROM tx LEFT JOIN mcc ON mcc.code = tx.mcc)
"""


def _requests(spark, sf_dir):
    return T.requests(T.events(spark, sf_dir))


@query(f"WITH {_FEATURES_SQL} SELECT * FROM fe")
def vectorize_transactions(spark, sf_dir):
    return vectorize.features(_requests(spark, sf_dir)).drop("request")


_CODES = ", ".join(
    f"CASE WHEN f{i} <= -0.5 THEN -10000 ELSE CAST(round(greatest(0::FLOAT, least(1::FLOAT, f{i})) * 10000::FLOAT) AS INT) END AS q{i}" for i in range(14)
)
_ROUTED_SQL = f"""
{_FEATURES_SQL},
qs AS (SELECT event_id, label, {_CODES} FROM fe),
routed AS (SELECT *, CASE WHEN q11 > 0 THEN 2 ELSE 0 END + CASE WHEN q5 >= 0 THEN 1 ELSE 0 END AS tag FROM qs)
"""


@query(f"WITH {_ROUTED_SQL} SELECT * EXCLUDE (label) FROM routed")
def route_transactions(spark, sf_dir):
    return vectorize.quantized(vectorize.features(_requests(spark, sf_dir)).drop("request", "label"))


@query(f"WITH {_FEATURES_SQL} SELECT event_id, f12 AS risk FROM fe")
def mcc_risk_join(spark, sf_dir):
    t = T.transactions(T.events(spark, sf_dir)).select("event_id", "mcc").withColumn("code0", S.risk_code(F.col("mcc")))
    risk = vectorize.risk_table(spark)
    return t.join(F.broadcast(risk), F.col("code0") == F.col("code"), "left").select(
        "event_id", F.coalesce("risk", S.f32(0.5)).alias("risk")
    )


@query(f"WITH {T.TX_SQL} SELECT event_id, list_contains(known_merchants, merchant_id) AS known FROM tx")
def known_merchant_flag(spark, sf_dir):
    return _requests(spark, sf_dir).select("event_id", vectorize.known_merchant(F.col("request")).alias("known"))


@query(f"""WITH {T.TX_SQL}, seen AS (SELECT event_id, unnest(known_merchants) AS m FROM tx)
SELECT event_id FROM tx WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.event_id = tx.event_id AND m = merchant_id)""")
def unknown_merchant_anti_join(spark, sf_dir):
    """The relational twin of the membership flag: an anti join with the merchants met before."""
    return T.unknown_merchants(T.events(spark, sf_dir))


@query(f"WITH {_FEATURES_SQL} SELECT event_id, f3 AS hour_feature, f4 AS weekday_feature, f5 AS minutes_feature FROM fe")
def time_features(spark, sf_dir):
    f = vectorize.features(_requests(spark, sf_dir))
    return f.select("event_id", F.col("f3").alias("hour_feature"), F.col("f4").alias("weekday_feature"), F.col("f5").alias("minutes_feature"))


@query(f"WITH {_FEATURES_SQL} SELECT * EXCLUDE (label) FROM fe")
def json_requests(spark, sf_dir):
    """Requests written as JSON text, parsed again by schema, then vectorized."""
    body = _requests(spark, sf_dir).select("event_id", F.to_json("request").alias("body"))
    return vectorize.features(R.parse(body)).drop("request", "body")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    e = T.events(spark, sf_dir)
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT c_custkey, least(64, greatest(1, coalesce(TRY_CAST(regexp_extract(substr(c_name, 10), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0)))::INT AS bounded FROM customer""")
def bounded_ints(spark, sf_dir):
    """Settings' texts as whole numbers within bounds; here, the numbers in customers' names."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", S.bounded_int(F.substring("c_name", 10, 20), 5, 1, 64).alias("bounded"))


@query(f"""WITH RECURSIVE s(i, x) AS (SELECT 0, {synthetic.FIRST}::BIGINT UNION ALL
SELECT i + 1, (x * {synthetic.FACTOR} + {synthetic.ADDEND}) % {synthetic.MODULUS} FROM s WHERE i < 8000)
SELECT CAST((i - 1) // 16 AS BIGINT) AS qid, CAST((i - 1) % 16 AS INT) AS place, x AS state, CAST(x // 256 AS FLOAT) / 16777216::FLOAT AS value FROM s WHERE i > 0""")
def synthetic_queries(spark, sf_dir):
    return synthetic.synthetic_queries(spark, 500)


# -- index ----------------------------------------------------------------------


@query(f"WITH {_ASSIGNED} SELECT ref_id, tag, cluster_id, dist FROM asg")
def cluster_assign(spark, sf_dir):
    return _index(spark, sf_dir)[2].select("ref_id", "tag", "cluster_id", "dist")


@query(f"WITH {_BOXES} SELECT tag, cluster_id, n FROM box")
def cluster_counts(spark, sf_dir):
    return _index(spark, sf_dir)[3].select("tag", "cluster_id", "n")


@query(f"WITH {_BOXES} SELECT * EXCLUDE (n, \"offset\") FROM box")
def cluster_bbox(spark, sf_dir):
    return E.unrolled(_index(spark, sf_dir)[3].drop("n", "offset"), "mn", "mx")


@query(f'WITH {_BOXES} SELECT tag, cluster_id, "offset" FROM box')
def cluster_offsets(spark, sf_dir):
    return _index(spark, sf_dir)[3].select("tag", "cluster_id", "offset")


@query(
    f"WITH {_ASSIGNED}, s AS (SELECT tag, cluster_id, count(*) AS n, {', '.join(f'sum(q{i}) AS s{i}' for i in range(D))} FROM asg GROUP BY tag, cluster_id) "
    f"SELECT cen.tag, cen.cluster_id, coalesce(n, 0) AS n, {', '.join(f'coalesce(CAST(s{i} AS DOUBLE) / n, CAST(cen.q{i} AS DOUBLE)) AS m{i}' for i in range(D))} "
    "FROM cen LEFT JOIN s ON cen.tag = s.tag AND cen.cluster_id = s.cluster_id"
)
def cluster_means(spark, sf_dir):
    _, centroids, assigned, _ = _index(spark, sf_dir)
    return E.unrolled(index.cluster_means(assigned, centroids, D), "m")


@query(f"""WITH {_ASSIGNED} SELECT ref_id, tag, cluster_id, row_number() OVER (PARTITION BY tag, cluster_id ORDER BY ref_id) - 1 AS pos_in_cluster,
row_number() OVER (PARTITION BY tag ORDER BY cluster_id, ref_id) - 1 AS pos_in_tag FROM asg""")
def record_positions(spark, sf_dir):
    return index.positions(_index(spark, sf_dir)[2])


@query(f"WITH {_BOXES} SELECT CAST(sum(n) AS BIGINT) AS n FROM box")
def record_total(spark, sf_dir):
    """All records, from the tables of all partitions."""
    return _index(spark, sf_dir)[3].agg(F.sum("n").alias("n"))


@query(
    f"WITH {_ASSIGNED}, m AS (SELECT cen.tag, cen.cluster_id, {', '.join(f'CAST(round(coalesce(avg(asg.q{i}), any_value(cen.q{i}))) AS INT) AS q{i}' for i in range(D))} "
    "FROM cen LEFT JOIN asg ON cen.tag = asg.tag AND cen.cluster_id = asg.cluster_id GROUP BY cen.tag, cen.cluster_id), "
    f"nd AS (SELECT r.ref_id, r.tag, m.cluster_id, {E.distance_sql('r', 'm')} AS dist FROM rec r JOIN m USING (tag)) "
    "SELECT ref_id, tag, cluster_id, dist FROM nd QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY dist, cluster_id) = 1"
)
def lloyd_round(spark, sf_dir):
    """Assignment to the centroids of one Lloyd step."""
    records = E.records(spark, sf_dir)
    return index.assign(records, index.lloyd(records, EP.clusters, D, 1), D).select("ref_id", "tag", "cluster_id", "dist")


@query()
def kmeans_mllib(spark, sf_dir):
    """Clusters by MLlib k-means; no SQL can run it, so tests check its fixpoint."""
    records = E.records(spark, sf_dir)
    centroids = index.kmeans(records, EP.clusters, D)
    return index.assign(records, centroids, D).select("ref_id", "tag", "cluster_id", "dist")


# -- search ---------------------------------------------------------------------


@query(f"WITH {_PAIRS} SELECT qid, tag, score, score < 0.5 AS approved, sum_dist, sum_id FROM voted")
def knn_exact_vote(spark, sf_dir):
    records = E.records(spark, sf_dir)
    q = E.queries_of(records)
    return search.vote(q, search.exact_neighbours(q, records, D, EP, not_self=True), EP)


@query(f"WITH {_PAIRS} SELECT qid, ref_id, dist, rn FROM top")
def knn_exact_neighbours(spark, sf_dir):
    records = E.records(spark, sf_dir)
    return search.exact_neighbours(E.queries_of(records), records, D, EP, not_self=True).select("qid", "ref_id", "dist", "rn")


@query(f"WITH {_RANKED} SELECT qid, tag, cluster_id, lb FROM rk")
def bbox_lower_bound(spark, sf_dir):
    records, _, _, clusters = _index(spark, sf_dir)
    return search.rank_clusters(E.queries_of(records), clusters, D).select("qid", "tag", "cluster_id", "lb")


@query(f"WITH {_RANKED} SELECT qid, cluster_id, rank FROM rk")
def cluster_rank(spark, sf_dir):
    records, _, _, clusters = _index(spark, sf_dir)
    return search.rank_clusters(E.queries_of(records), clusters, D).select("qid", "cluster_id", "rank")


def _ivf(spark, sf_dir, repair=True):
    records, _, assigned, clusters = _index(spark, sf_dir)
    return search.probe(E.queries_of(records), clusters, assigned, D, EP, repair, not_self=True)


@query(f"""WITH {_IVF}, v AS (SELECT qid, CAST(sum(label) AS INT) AS frauds, min(d) AS d1, arg_min(label, [CAST(d AS DOUBLE), rank, ref_id]) AS l1,
CAST(sum(dist) AS BIGINT) AS sum_dist, CAST(sum(ref_id) AS BIGINT) AS sum_id FROM t1 GROUP BY qid),
w AS (SELECT rec.ref_id AS qid, coalesce({_VOTE.format(early=EP.early_exit)}, 0) AS score, coalesce(sum_dist, 0) AS sum_dist, coalesce(sum_id, 0) AS sum_id
FROM rec LEFT JOIN v ON v.qid = rec.ref_id) SELECT qid, score, score < 0.5 AS approved, sum_dist, sum_id FROM w""")
def knn_ivf_stage1(spark, sf_dir):
    return _ivf(spark, sf_dir, repair=False).select("qid", "score", "approved", "sum_dist", "sum_id")


@query(f"""WITH {_IVF}, v AS (SELECT s1.qid, s1.tag, coalesce({_VOTE.format(early=EP.early_exit).replace('frauds', 'frauds2')}, 0) AS score,
coalesce(sum_dist, 0) AS sum_dist, coalesce(sum_id, 0) AS sum_id FROM s1 LEFT JOIN fin USING (qid))
SELECT qid, tag, score, score < 0.5 AS approved, sum_dist, sum_id FROM v""")
def knn_ivf_decision(spark, sf_dir):
    return _ivf(spark, sf_dir).select("qid", "tag", "score", "approved", "sum_dist", "sum_id")


@query(f"WITH {_IVF} SELECT * FROM stats")
def knn_ivf_stats(spark, sf_dir):
    return _ivf(spark, sf_dir).select("qid", "clusters_probed", "vectors_scanned", "repair_triggered", "early_exit_taken")


@query(f"""WITH {_IVF} SELECT qid, CAST(sum_dist AS BIGINT) AS sum_dist, CAST(sum_id AS BIGINT) AS sum_id FROM fin
JOIN s1 USING (qid) WHERE frauds BETWEEN 1 AND {EP.k - 1}""")
def knn_ivf_repair(spark, sf_dir):
    """The neighbours of the queries whose first vote was ambiguous."""
    return _ivf(spark, sf_dir).where("repair_triggered = 1").select("qid", "sum_dist", "sum_id")


@query(f"""WITH {_PAIRS} SELECT '{{"approved":' || (score < 0.5) || ',"fraud_score":' || printf('%.1f', score) || '}}' AS response, qid FROM voted""")
def decision_responses(spark, sf_dir):
    v = knn_exact_vote(spark, sf_dir)
    return v.select("qid", R.response(F.col("score"), F.col("approved")).alias("response"))


# -- requests, end to end ---------------------------------------------------------

#: Four of five events are references, the others arrive as requests; every seventh of those is cut off.
_PARTS = f"""
{_ROUTED_SQL},
rec AS (SELECT event_id AS ref_id, tag, label, {", ".join(f"q{i}" for i in range(DIM))} FROM routed WHERE event_id % 5 <> 0),
qry AS (SELECT event_id AS qid, tag, {", ".join(f"q{i}" for i in range(DIM))} FROM routed WHERE event_id % 5 = 0 AND event_id % 7 <> 0)
"""
_SERVED = f"""
{_ivf_sql(_PARTS, DIM, SearchParams(), False)["ivf"]},
decided AS (SELECT s1.qid, coalesce({_VOTE.format(early=SearchParams().early_exit).replace("frauds", "frauds2")}, 0) AS score FROM s1 LEFT JOIN fin USING (qid)),
served AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'tx-' || event_id WHEN event_id % 3 = 2 THEN '7' END AS id,
  CASE WHEN score IS NULL THEN 400 ELSE 200 END AS status, score,
  '{{"approved":' || (score < 0.5) || ',"fraud_score":' || printf('%.1f', score) || '}}' AS response,
  clusters_probed, vectors_scanned, repair_triggered, early_exit_taken
 FROM routed LEFT JOIN decided ON decided.qid = event_id LEFT JOIN stats ON stats.qid = event_id WHERE event_id % 5 = 0)
"""


def _bodies_and_index(spark, sf_dir):
    """Request bodies (event_id, body) with ids of all kinds, and an index of the other events."""
    t = stage(_requests(spark, sf_dir), "requests")
    records = vectorize.quantized(vectorize.features(t.where("event_id % 5 <> 0")).drop("request")).withColumnRenamed("event_id", "ref_id")
    records = stage(records, "references")  # the index reads them twice, and vectorizing costs most
    i = F.col("event_id")
    name = F.when(i % 3 == 0, F.concat(F.lit("tx-"), i)).when(i % 3 == 2, "7")
    asked = t.where("event_id % 5 = 0").withColumn("request", F.col("request").withField("id", name))
    body = F.to_json("request")
    bodies = asked.select("event_id", F.when(i % 7 == 0, F.substring(body, 1, 40)).otherwise(body).alias("body"))
    return bodies, Index.build(records, DIM, SearchParams())


@query(f"WITH {_SERVED} SELECT * FROM served")
def score_requests(spark, sf_dir):
    """JSON bodies to decisions with production parameters: parse, features, tag, probe, repair, vote, response."""
    bodies, ix = _bodies_and_index(spark, sf_dir)
    return score_batch(bodies, ix).select(
        "event_id", "id", "status", "score", "response", "clusters_probed", "vectors_scanned", "repair_triggered", "early_exit_taken"
    )


@query(f"""WITH {_SERVED}, a AS (SELECT event_id, response, CASE event_id % 11 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 400 WHEN 4 THEN NULL ELSE status END AS status FROM served)
SELECT event_id, status, CASE WHEN event_id % 11 = 1 THEN 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Length: 2' || chr(13) || chr(10) || chr(13) || chr(10) || 'OK'
 WHEN status = 200 THEN 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: application/json' || chr(13) || chr(10) || 'Content-Length: ' || strlen(response) || chr(13) || chr(10) || chr(13) || chr(10) || response
 WHEN status = 404 THEN 'HTTP/1.1 404 Not Found' || chr(13) || chr(10) || 'Content-Length: 0' || chr(13) || chr(10) || chr(13) || chr(10)
 WHEN status = 400 THEN 'HTTP/1.1 400 Bad Request' || chr(13) || chr(10) || 'Content-Length: 0' || chr(13) || chr(10) || 'Connection: close' || chr(13) || chr(10) || chr(13) || chr(10) END AS answer FROM a""")
def http_answers(spark, sf_dir):
    """Raw HTTP requests to whole answers: readiness, unknown routes, no length, incomplete ones, and scores."""
    bodies, ix = _bodies_and_index(spark, sf_dir)
    kind, size = F.col("event_id") % 11, F.octet_length("body")
    head = F.concat(F.lit("POST /fraud-score HTTP/1.1\r\nHost: x\r\nContent-Length: "), size + F.when(kind == 4, 1).otherwise(0), F.lit("\r\n\r\n"))
    raw = (
        F.when(kind == 1, F.lit("GET /ready HTTP/1.1\r\n\r\n"))
        .when(kind == 2, F.lit("GET /other HTTP/1.1\r\n\r\n"))
        .when(kind == 3, F.concat(F.lit("POST /fraud-score HTTP/1.1\r\n\r\n"), "body"))
        .otherwise(F.concat(head, "body"))
    )
    asked = stage(bodies.select("event_id", raw.alias("raw")), "raw")  # else each use of the text writes its JSON again
    return serve(asked, ix).select("event_id", "status", "answer")


# -- evaluation -------------------------------------------------------------------


@query(f"""WITH {_PAIRS} SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
count(*) FILTER ((label = 1) <> (score >= 0.5)) AS errors FROM voted""")
def confusion_matrix(spark, sf_dir):
    truth = E.records(spark, sf_dir).select(F.col("ref_id").alias("qid"), "label")
    return evaluate.confusion_matrix(knn_exact_vote(spark, sf_dir).join(truth, "qid"))


@query(f"""WITH {_IVF}, {_PAIRS.replace(E.RECORDS_SQL + ',', '', 1)},
a AS (SELECT s1.qid, coalesce({_VOTE.format(early=EP.early_exit).replace('frauds', 'frauds2')}, 0) < 0.5 AS approved, sum_dist, sum_id FROM s1 LEFT JOIN fin USING (qid))
SELECT count(*) AS queries, count(*) FILTER (a.approved = (voted.score < 0.5)) AS same_decision,
count(*) FILTER (a.sum_dist = voted.sum_dist AND a.sum_id = voted.sum_id) AS same_neighbours FROM a JOIN voted USING (qid)""")
def ivf_vs_exact_recall(spark, sf_dir):
    return evaluate.recall(_ivf(spark, sf_dir), knn_exact_vote(spark, sf_dir))


# -- telemetry ----------------------------------------------------------------------


def _samples(spark, sf_dir):
    """Events as latency samples: seq is the event's number, ns come from its value."""
    e = T.events(spark, sf_dir)
    v = F.floor(F.col("value").cast("decimal(18,6)") * 1000).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        (F.col("event_id") + 1).alias("seq"), v.alias("recv_ns"), (v * 2 + k).alias("json_ns"), (v * 7 + k * 3).alias("knn_ns"),
        (v + 11).alias("send_ns"), (v * 11 + k * 4 + 11).alias("total_ns"), (k % 11).alias("clusters_probed"), (k * 17).alias("vectors_scanned"),
        (k % 3 == 0).cast("int").alias("repair_triggered"), (k % 7 == 0).cast("int").alias("early_exit_taken"),
    )


_SAMPLES_SQL = """
s0 AS (SELECT event_id + 1 AS seq, CAST(floor(CAST(value AS DECIMAL(18,6)) * 1000) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
smp AS (SELECT seq, v AS recv_ns, v * 2 + k AS json_ns, v * 7 + k * 3 AS knn_ns, v + 11 AS send_ns, v * 11 + k * 4 + 11 AS total_ns,
        k % 11 AS clusters_probed, k * 17 AS vectors_scanned, CAST(k % 3 = 0 AS INT) AS repair_triggered, CAST(k % 7 = 0 AS INT) AS early_exit_taken FROM s0),
lst AS (SELECT * FROM smp ORDER BY seq DESC LIMIT 4096)
"""
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS ns FROM lst" for m in telemetry.STAGES)


@query(f"WITH {_SAMPLES_SQL} SELECT * FROM lst")
def perf_last_n(spark, sf_dir):
    return telemetry.newest(_samples(spark, sf_dir))


@query(f"""WITH {_SAMPLES_SQL}, lg AS ({_LONG}) SELECT metric, CAST(floor(quantile_cont(ns, 0.5)) AS BIGINT) AS p50_ns,
CAST(floor(quantile_cont(ns, 0.99)) AS BIGINT) AS p99_ns, max(ns) AS max_ns, count(*) AS n FROM lg GROUP BY metric""")
def perf_percentiles(spark, sf_dir):
    return telemetry.percentiles(telemetry.newest(_samples(spark, sf_dir)))


@query(f"""WITH {_SAMPLES_SQL} SELECT avg(clusters_probed) AS avg_clusters, avg(vectors_scanned) AS avg_vectors,
avg(repair_triggered) * 100 AS repair_pct, avg(early_exit_taken) * 100 AS early_exit_pct, count(*) AS n FROM lst""")
def perf_detail(spark, sf_dir):
    return telemetry.detail(telemetry.newest(_samples(spark, sf_dir)))


@query(f"""WITH {_SAMPLES_SQL}, r AS (SELECT DISTINCT seq AS due FROM smp WHERE seq % 200 = 0)
SELECT due AS seq, count(*) AS n, CAST(floor(quantile_cont(total_ns, 0.5)) AS BIGINT) AS p50_ns, CAST(floor(quantile_cont(total_ns, 0.99)) AS BIGINT) AS p99_ns,
max(total_ns) AS max_ns FROM r JOIN smp ON smp.seq <= due AND smp.seq > due - 4096 GROUP BY due""")
def perf_report_points(spark, sf_dir):
    return telemetry.report_points(_samples(spark, sf_dir))


@query(f"""WITH {_SAMPLES_SQL} SELECT seq, row_number() OVER (ORDER BY seq) AS "count",
CAST(sum(total_ns) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_ns FROM smp""")
def perf_running_totals(spark, sf_dir):
    return telemetry.running_totals(_samples(spark, sf_dir))


_UNTIMED_SQL = _SAMPLES_SQL.replace("v * 11 + k * 4 + 11 AS total_ns", "CASE WHEN k % 5 = 0 THEN 0 ELSE v * 11 + k * 4 + 11 END AS total_ns")
_TIMED_SQL = _UNTIMED_SQL.replace("FROM smp ORDER", "FROM smp WHERE total_ns > 0 ORDER")


def _partly_timed(spark, sf_dir):
    """Samples of which some were never timed."""
    s = _samples(spark, sf_dir)
    k = F.col("vectors_scanned") / 17
    return s.withColumn("total_ns", F.when(k % 5 == 0, 0).otherwise(F.col("total_ns")).cast("bigint"))


@query(f"WITH {_UNTIMED_SQL} SELECT * FROM smp WHERE total_ns > 0")
def perf_recorded(spark, sf_dir):
    return telemetry.recorded(_partly_timed(spark, sf_dir))


_REPORT_COLS = ", ".join(
    f"CAST(floor(quantile_cont({m}, 0.5)) AS BIGINT) AS {m[:-3]}_p50_ns, CAST(floor(quantile_cont({m}, 0.99)) AS BIGINT) AS {m[:-3]}_p99_ns, max({m}) AS {m[:-3]}_max_ns"
    for m in telemetry.STAGES
)
_REPORT_SQL = f"""
{_TIMED_SQL},
rep AS (SELECT (SELECT count(*) FROM smp WHERE total_ns > 0) AS seen, count(*) AS kept, {_REPORT_COLS}, avg(clusters_probed) AS avg_clusters,
 avg(vectors_scanned) AS avg_vectors, avg(repair_triggered) * 100 AS repair_pct, avg(early_exit_taken) * 100 AS early_exit_pct FROM lst)
"""


@query(f"WITH {_REPORT_SQL} SELECT * FROM rep")
def perf_report(spark, sf_dir):
    """The combined report: one row."""
    return telemetry.report(_partly_timed(spark, sf_dir))


@query(
    f"WITH {_REPORT_SQL} SELECT printf('[PERF] N=%d |', seen) || "
    + " || ".join(f"printf(' {m[:-3]}: p50=%.3f p99=%.3f max=%.3f', {m[:-3]}_p50_ns / 1e6, {m[:-3]}_p99_ns / 1e6, {m[:-3]}_max_ns / 1e6)" for m in telemetry.STAGES)
    + " || printf(' | knn_detail: avg_clusters=%.1f avg_vecs=%.1f repair=%.1f%% early_exit=%.1f%%', avg_clusters, avg_vectors, repair_pct, early_exit_pct) AS line FROM rep"
)
def perf_report_line(spark, sf_dir):
    return telemetry.report_line(telemetry.report(_partly_timed(spark, sf_dir)))


def prepare(spark: SparkSession) -> None:
    """What a session needs before queries that run Python on executors."""
    ship(spark)
