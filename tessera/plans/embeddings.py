"""The embeddings table as labelled, quantized, tagged vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..params import EMBEDDING_DIM, TAG_HIGH, TAG_LOW


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, tag, label, q).  Values in [-1, 1] are mapped to [0, 1] first;
    the tag is taken from the raw signs, so all four partitions fill."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.col("vec_id").alias("ref_id"),
        S.tag(F.element_at("embedding", TAG_HIGH + 1), F.element_at("embedding", TAG_LOW + 1)).alias("tag"),
        (F.col("label") < 4).cast("int").alias("label"),
        F.transform("embedding", lambda x: S.quantize(S.f32((x + S.f32(1.0)) * S.f32(0.5)))).alias("q"),
    )


def unrolled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with array columns spread to one column a dimension."""
    return df.select("*", *[F.col(n)[i].alias(f"{n}{i}") for n in names for i in range(EMBEDDING_DIM)]).drop(*names)


def queries_of(records_: DataFrame) -> DataFrame:
    return records_.withColumnRenamed("ref_id", "qid").drop("label")


def _q(i: int) -> str:
    x = f"CAST((embedding[{i + 1}] + CAST(1 AS FLOAT)) * CAST(0.5 AS FLOAT) AS FLOAT)"
    return f"CASE WHEN {x} <= -0.5 THEN -10000 ELSE CAST(round(greatest(CAST(0 AS FLOAT), least(CAST(1 AS FLOAT), {x})) * CAST(10000 AS FLOAT)) AS INT) END AS q{i}"


#: The same records for DuckDB, as the view ``rec``.
RECORDS_SQL = f"""
rec AS (SELECT vec_id AS ref_id,
        CASE WHEN embedding[{TAG_HIGH + 1}] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[{TAG_LOW + 1}] >= 0 THEN 1 ELSE 0 END AS tag,
        CAST(label < 4 AS INT) AS label, {", ".join(_q(i) for i in range(EMBEDDING_DIM))} FROM embeddings)
"""


def distance_sql(a: str, b: str, dim: int = EMBEDDING_DIM) -> str:
    return "(" + " + ".join(f"CAST(({a}.q{i} - {b}.q{i}) * ({a}.q{i} - {b}.q{i}) AS BIGINT)" for i in range(dim)) + ")"


def bound_sql(q: str, c: str, dim: int = EMBEDDING_DIM) -> str:
    d = [f"CAST(greatest({q}.q{i} - {c}.mx{i}, {c}.mn{i} - {q}.q{i}, 0) AS BIGINT)" for i in range(dim)]
    return "(" + " + ".join(f"{x} * {x}" for x in d) + ")"
