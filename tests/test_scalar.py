import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import temporal as D
from tessera.operators import vectorize
from tessera.sources import requests as R


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("v,want", [(-0.5, -10000), (-0.4, 0), (0.0, 0), (0.00005, 1), (1.0, 10000), (1.2, 10000), (-1.0, -10000)])
def test_quantize(spark, v, want):
    assert one(spark, S.quantize(F.lit(v).cast("float"))) == want


@pytest.mark.parametrize(
    "s,want",
    [
        ("1970-01-02T00:00:00Z", 86400), ("1970-01-02T00:00:00.123Z", 86400), ("1970-01-02T02:00:00+02:00", 86400),
        ("1970-01-02 00:00:00", 86400), ("1970-01-02", 0), ("garbage that is long enough", 0), (None, 0),
    ],
)
def test_epoch_seconds(spark, s, want):
    assert one(spark, D.epoch_seconds(F.lit(s).cast("string"))) == want


SAMPLE = {
    "id": "tx-1",
    "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003"]},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
    "last_transaction": None,
}


def vector(spark, **changes):
    body = json.loads(json.dumps(SAMPLE))
    for path, value in changes.items():
        *head, last = path.split("__")
        at = body
        for h in head:
            at = at[h]
        at[last] = value
    df = R.parse(spark.createDataFrame([(json.dumps(body),)], "body string"))
    return list(vectorize.features(df).select(*[f"f{i}" for i in range(14)]).first())


def test_sample_request(spark):
    want = [0.004112, 2 / 12, 0.05, 18 / 23, 2 / 6, -1, -1, 0.02923, 0.15, 0, 1, 1, 0.15, 0.006025]
    assert vector(spark) == pytest.approx(want, abs=1e-6)


def test_feature_edges(spark):
    assert vector(spark, customer__avg_amount=0)[2] == 0
    assert vector(spark, transaction__amount=1e6)[0] == 1 and vector(spark, transaction__amount=-5)[0] == 0
    assert vector(spark, merchant__mcc="12")[12] == 0.5 and vector(spark, merchant__mcc="x5411")[12] == 0.5
    late = {"timestamp": "2026-03-11T19:45:53Z", "km_from_current": 2000}
    f = vector(spark, last_transaction=late)
    assert f[5] == pytest.approx(60 / 1440) and f[6] == 1
    assert vector(spark, customer__known_merchants=["MERC-016"])[11] == 0
    assert vector(spark, customer__known_merchants=[])[11] == 1
    assert vector(spark, customer__known_merchants=[f"M{i}" for i in range(32)] + ["MERC-016"])[11] == 1


def test_malformed_body_and_http(spark):
    df = R.parse(spark.createDataFrame([("{nope",), ('{"id":"1"}',)], "body string"))
    assert [r["request"] for r in df.collect()] == [None, None]
    assert one(spark, R.content_length(F.lit("POST / HTTP/1.1\r\nContent-Length: 42\r\n"))) == 42
    assert one(spark, R.content_length(F.lit("GET / HTTP/1.1"))) is None
    assert one(spark, R.route(F.lit("POST /fraud-score HTTP/1.1"))) == "score"
    assert one(spark, R.response(F.lit(0.4), F.lit(True))) == '{"approved":true,"fraud_score":0.4}'
