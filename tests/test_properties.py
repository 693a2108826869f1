import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import Settings, bounded_int, load_settings
from tessera.functions import scalar as S
from tessera.functions.vector import box_bound, squared_distance
from tessera.operators import kernels
from tessera.sources import synthetic

codes = st.integers(-10000, 10000)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(codes, min_size=3, max_size=3), min_size=1, max_size=12), st.lists(st.lists(codes, min_size=3, max_size=3), min_size=1, max_size=12), st.integers(1, 5))
def test_nearest_equals_sorting(a, b, k):
    d = kernels.squared(np.array(a, float), np.array(b, float))
    assert d.tolist() == [[sum((x - y) ** 2 for x, y in zip(p, q)) for q in b] for p in a]
    ids = np.random.default_rng(len(b)).permutation(len(b))
    row, col = kernels.nearest(d, ids, k)
    for r in range(len(a)):
        want = sorted(range(len(b)), key=lambda c: (np.float32(d[r, c]), ids[c]))[:k]
        assert col[row == r].tolist() == want


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(codes, codes, codes, codes), min_size=1, max_size=10), st.tuples(codes, codes))
def test_box_bound_is_the_least_distance(points, q):
    low, high = np.minimum.reduce(points, axis=0)[None, :2].astype(float), np.maximum.reduce(points, axis=0)[None, :2].astype(float)
    bound = kernels.box_bounds(np.array([q], float), low, high)[0, 0]
    inside = np.clip(q, low[0], high[0])
    assert bound == ((np.array(q) - inside) ** 2).sum()


def test_expressions_equal_kernels(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, *map(int, rnd.integers(-10000, 10001, 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "ref_id int, q0 int, q1 int, q2 int, q3 int")
    box = spark.createDataFrame([(-50, 60, 0, 10, -9, 9, 5, 5)], "mn0 int, mx0 int, mn1 int, mx1 int, mn2 int, mx2 int, mn3 int, mx3 int")
    got = df.alias("a").join(df.alias("b"), F.col("a.ref_id") >= F.col("b.ref_id")).select(F.col("a.ref_id").alias("x"), F.col("b.ref_id").alias("y"), squared_distance("a", "b", 4).alias("d")).collect()
    q = np.array([r[1:] for r in rows], float)
    d = kernels.squared(q, q)
    assert all(r["d"] == d[r["x"], r["y"]] for r in got)
    bounds = kernels.box_bounds(q, np.array([[-50.0, 0, -9, 5]]), np.array([[60.0, 10, 9, 5]]))[:, 0]
    got = df.alias("q").crossJoin(box.alias("c")).select("ref_id", box_bound("q", "c", 4).alias("d")).collect()
    assert all(r["d"] == bounds[r["ref_id"]] for r in got)


@settings(deadline=None, max_examples=80)
@given(st.text(max_size=12), st.integers(-5, 5), st.integers(0, 20))
def test_bounded_int(text, low, more):
    n = bounded_int(text, 3, low, low + more)
    assert low <= n <= low + more and bounded_int(str(n), 0, low, low + more) == n and bounded_int(None, 3, low, low) == 3


def test_settings_and_columns(spark):
    assert load_settings(env={}) == Settings() and load_settings(env={"TESSERA_NPROBE": "900x"}).params().nprobe == 64
    spark.conf.set("spark.tessera.nprobe", "-4")
    assert load_settings(spark, {"TESSERA_NPROBE": "9", "TESSERA_INDEX_PATH": "/x"}) == Settings("/x", 1, 0)
    spark.conf.unset("spark.tessera.nprobe")
    texts = ["12", " 7 apples", "-3", "none", "", None, "999999999999999999999999"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.bounded_int(F.col("t"), 5, 1, 64).alias("x")).collect()]
    assert got[:6] == [bounded_int(t, 5, 1, 64) for t in texts[:6]] and got[6] in (1, 64)


def test_quantize_equals_single_precision(spark):
    xs = np.random.default_rng(1).uniform(-1.5, 1.5, 400).astype(np.float32).tolist() + [0.5, -0.5, 0.00005, 1.0]
    got = [r["q"] for r in spark.createDataFrame([(x,) for x in xs], "x float").select(S.quantize(F.col("x")).alias("q")).collect()]
    for x, q in zip(xs, got):
        y = np.float32(min(1.0, max(0.0, np.float32(x)))) * np.float32(10000)
        assert q == (-10000 if np.float32(x) <= -0.5 else int(np.floor(float(y) + 0.5)))


def test_generator_jumps_equal_steps(spark):
    x, want = synthetic.FIRST, []
    for _ in range(64):
        x = (x * synthetic.FACTOR + synthetic.ADDEND) % synthetic.MODULUS
        want.append(x)
    assert synthetic.states(np.arange(1, 65)).tolist() == want
    got = synthetic.synthetic_queries(spark, 4).orderBy("qid", "place").collect()
    assert [r["state"] for r in got] == want and all(0 <= r["value"] < 1 for r in got)
