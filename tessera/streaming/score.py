"""Streaming: requests scored as they arrive, and a report every N samples."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search, telemetry
from ..operators.vectorize import features, quantized
from ..params import SearchParams
from ..sources.index_store import Index
from ..runtime import scratch_scope, stage
from ..sources.requests import READY, answer, parse, response, split_request

BATCH_TIMES = "number bigint, rows bigint, search_ns bigint, write_ns bigint, total_ns bigint"


def score_batch(bodies: DataFrame, index: Index, params: SearchParams = SearchParams()) -> DataFrame:
    """One row per request body: the columns of ``bodies``, then key, id, status,
    score, approved, response, answer and the search's counters.

    Rows are told apart by ``key``, a number of their own: the request's id is data,
    whatever it holds and however often it occurs.  A body that is no request is
    answered 400, without a score.
    """
    keyed = parse(bodies).withColumn("key", F.monotonically_increasing_id())
    asked = stage(keyed, "requests")  # numbers are dealt once
    q = features(asked.where(F.col("request").isNotNull()).select(F.col("key").alias("qid"), "request")).drop("request")
    q = stage(quantized(q), "vectors")
    found = search.probe(q, index.clusters, index.records, index.dim, params).withColumnsRenamed({"qid": "key"}).drop("sum_dist", "sum_id")
    out = asked.withColumn("id", F.col("request.id")).drop("request").join(found, "key", "left")
    out = out.withColumn("status", F.when(F.col("score").isNull(), 400).otherwise(200))
    out = out.withColumn("response", F.when(F.col("score").isNotNull(), response(F.col("score"), F.col("approved"))))
    return out.withColumn("answer", answer(F.col("status"), F.col("response")))


def serve(requests: DataFrame, index: Index, params: SearchParams = SearchParams(), raw: str = "raw") -> DataFrame:
    """``requests`` with ``status`` and ``answer`` for each raw HTTP request text.

    Readiness, unknown routes and requests without a length are answered here, all
    others by ``score_batch``; a request that is not complete yet has no answer.
    """
    split = requests.withColumn("asked", split_request(F.col(raw)))
    kind, body = F.col("asked.kind"), F.col("asked.body")
    posted = split.where((kind == "score") & body.isNotNull()).withColumn("body", body).drop("asked")
    done = score_batch(posted, index, params).select(*requests.columns, "status", "answer")
    rest = split.where((kind != "score") | body.isNull())
    status = F.when(kind == "incomplete", F.lit(None)).when(kind == "score", 400).when(kind == "unknown", 404).otherwise(200)
    text = F.when(kind.isin("ready", "report"), F.lit(READY)).when(status.isNotNull(), answer(status, F.lit("")))
    rest = rest.withColumn("status", status.cast("int")).withColumn("answer", text)
    return done.unionByName(rest.select(*requests.columns, "status", "answer"))


def score_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    index: Index,
    params: SearchParams = SearchParams(),
    files_per_trigger: int = 8,
    after: Callable[[DataFrame, int], None] | None = None,
):
    """Scores text files of request lines as they appear in ``source``.

    The index stays with the executors from batch to batch.  Ranking per query
    isn't a time window, so each micro-batch is scored as a batch; its output is
    written under its number and overwritten if the batch is run again, which
    makes a replay harmless.  ``{sink}.times`` gets a row per batch: rows, and the
    nanoseconds of a monotonic clock that planning, running and writing took.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(source)
    index = index.resident()

    def each(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        with scratch_scope(own) as scratch:
            at = [time.monotonic_ns()]
            done = score_batch(batch.withColumnRenamed("value", "body"), index, params)
            at.append(time.monotonic_ns())
            done.write.mode("overwrite").parquet(f"{sink}/batch={number}")
            at.append(time.monotonic_ns())
            scratch.release()
        written = own.read.parquet(f"{sink}/batch={number}")
        stamp = [(number, written.count(), at[1] - at[0], at[2] - at[1], at[2] - at[0])]
        own.createDataFrame(stamp, BATCH_TIMES).coalesce(1).write.mode("overwrite").parquet(f"{sink}.times/batch={number}")
        if after:
            after(written, number)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, every: int = telemetry.EVERY, ring: int = telemetry.RING):
    """Appends arriving samples to ``sink``/samples and rewrites the reports that are due.

    Samples are kept under their batch's number, with their range of seq in the
    folder's name; a report opens only the folders that reach into its ring.
    """
    samples = spark.readStream.schema(schema).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        seen = batch.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
        if seen["lo"] is None:
            return
        batch.write.mode("overwrite").parquet(f"{sink}/samples/upto={seen['hi']}/batch={number}")
        kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{sink}/samples").where(f"upto > {seen['lo'] - ring - every}")
        kept = telemetry.recorded(kept).where(F.col("seq") > seen["lo"] - ring - every).drop("upto", "batch")
        due = telemetry.report_points(kept, every, ring).where(F.col("seq").between(seen["lo"], seen["hi"]))
        due.write.mode("overwrite").parquet(f"{sink}/reports/batch={number}")

    return samples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
