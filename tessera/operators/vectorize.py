"""Requests to feature vectors, and vectors to quantized columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import scalar as S
from ..functions import temporal as D


def risk_table(spark) -> DataFrame:
    return spark.createDataFrame(list(P.MCC_RISK.items()), "code string, risk double").withColumn("risk", F.col("risk").cast("float"))


def known_merchant(request: Column) -> Column:
    known = F.slice(request["customer"]["known_merchants"], 1, P.KNOWN_MERCHANTS_READ)
    return F.coalesce(F.array_contains(known, request["merchant"]["id"]), F.lit(False))


def features(requests: DataFrame, request: str = "request") -> DataFrame:
    """``requests`` with columns f0..f13.

    One projection and one left join with the ten-row risk table.
    """
    r = F.col(request)
    at = D.epoch_seconds(r["transaction"]["requested_at"])
    last = r["last_transaction"]
    amount = r["transaction"]["amount"]
    out = requests.withColumn("__code", S.risk_code(r["merchant"]["mcc"]))
    table = risk_table(requests.sparkSession)
    out = out.join(F.broadcast(table), F.col("__code") == F.col("code"), "left")
    none = S.f32(-1.0)
    made = [
        S.scaled(amount, P.MAX_AMOUNT),
        S.scaled(r["transaction"]["installments"], P.MAX_INSTALLMENTS),
        S.guarded_ratio(amount, r["customer"]["avg_amount"], P.AMOUNT_VS_AVG_RATIO),
        D.hour_feature(at),
        D.weekday_feature(at),
        F.when(last.isNull(), none).otherwise(D.minutes_apart(at, D.epoch_seconds(last["timestamp"]), P.MAX_MINUTES)),
        F.when(last.isNull(), none).otherwise(S.scaled(last["km_from_current"], P.MAX_KM)),
        S.scaled(r["terminal"]["km_from_home"], P.MAX_KM),
        S.scaled(r["customer"]["tx_count_24h"], P.MAX_TX_COUNT_24H),
        S.flag(r["terminal"]["is_online"]),
        S.flag(r["terminal"]["card_present"]),
        S.flag(~known_merchant(r)),
        F.coalesce(F.col("risk"), S.f32(P.DEFAULT_RISK)),
        S.scaled(r["merchant"]["avg_amount"], P.MAX_MERCHANT_AVG),
    ]
    return out.select(*[F.col(f"`{c}`") for c in requests.columns], *[x.alias(f"f{i}") for i, x in enumerate(made)])


def quantized(df: DataFrame, dim: int = P.DIM, prefix: str = "f", tagged: bool = True) -> DataFrame:
    """``df`` with q0.. in place of f0.., and the partition tag."""
    keep = [c for c in df.columns if c not in {f"{prefix}{i}" for i in range(dim)}]
    out = df.select(*keep, *[S.quantize(F.col(f"{prefix}{i}")).alias(f"q{i}") for i in range(dim)])
    return out.withColumn("tag", S.tag(F.col(f"q{P.TAG_HIGH}"), F.col(f"q{P.TAG_LOW}"))) if tagged else out
