"""Request and reference files, responses, and framing of raw HTTP text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DIM
from ..schemas import REFERENCE, REQUEST


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON request per line as (body, request); a malformed body has a null request."""
    return parse(spark.read.text(path).withColumnRenamed("value", "body"))


def parse(bodies: DataFrame, body: str = "body") -> DataFrame:
    return bodies.withColumn("request", F.from_json(body, REQUEST, {"mode": "PERMISSIVE"})).withColumn(
        "request", F.when(F.col("request.transaction").isNotNull(), F.col("request"))
    )


def read_references(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A JSON array of labelled vectors, plain or gzip, as (ref_id, label, f0..f13).

    Such a file is one split, read by one task; ids are its order, and the rows are
    dealt to ``partitions`` (the shuffle's by default) right after it.  Records
    without 14 numbers are dropped.
    """
    raw = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    kept = raw.where(F.size("vector") == DIM)
    return kept.select(
        F.monotonically_increasing_id().alias("ref_id"),
        F.coalesce((F.col("label") == "fraud").cast("int"), F.lit(0)).alias("label"),
        *[F.element_at("vector", i + 1).alias(f"f{i}") for i in range(DIM)],
    ).repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "ref_id")


def response(score: Column, approved: Column) -> Column:
    """The response body: the decision and the score with one decimal."""
    return F.concat(F.lit('{"approved":'), approved.cast("string"), F.lit(',"fraud_score":'), F.format_string("%.1f", score), F.lit("}"))


def content_length(head: Column) -> Column:
    """Length announced by a request head, null if there is none."""
    n = F.regexp_extract(head, r"(?:^|\n)Content-Length:[ \t]*([0-9]+)", 1)
    return F.when(n != "", n.cast("bigint"))


def route(line: Column) -> Column:
    """Which service a request line asks for."""
    return (
        F.when(line.startswith("GET /ready"), "ready")
        .when(line.startswith("GET /inst"), "report")
        .when(line.startswith("POST /fraud-score"), "score")
        .otherwise("unknown")
    )


def header_end(raw: Column) -> Column:
    """Where the head of raw request text ends (before its blank line); null while it has no end."""
    at = F.instr(raw, "\r\n\r\n")
    return F.when(at > 0, at - 1)


def split_request(raw: Column) -> Column:
    """Struct of a raw request's kind, announced body length, body and whether it is complete."""
    end = header_end(raw)
    head = F.substring(raw, F.lit(1), end)
    length = content_length(head)
    kind = F.when(end.isNull(), "incomplete").otherwise(route(raw))
    whole = F.octet_length(raw) >= F.octet_length(head) + 4 + F.coalesce(length, F.lit(0))
    kind = F.when((kind == "score") & length.isNotNull() & ~whole, "incomplete").otherwise(kind)
    body = F.decode(F.substring(raw.cast("binary"), F.octet_length(head) + 5, length.cast("int")), "UTF-8")
    return F.struct(kind.alias("kind"), length.alias("length"), F.when((kind == "score") & length.isNotNull(), body).alias("body"))


#: Status lines and further headers of answers (fixed values).
STATUS = {200: "OK", 400: "Bad Request", 404: "Not Found", 500: "Internal Server Error"}


def answer(status: Column, body: Column) -> Column:
    """The whole HTTP answer: a JSON body after 200, no body after an error."""
    text = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[status]
    line = F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), text, F.lit("\r\n"))
    close = F.when(status.isin(400, 500), "Connection: close\r\n").otherwise("")
    return F.when(
        status == 200,
        F.concat(line, F.lit("Content-Type: application/json\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body),
    ).otherwise(F.concat(line, F.lit("Content-Length: 0\r\n"), close, F.lit("\r\n")))


READY = "HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nOK"
