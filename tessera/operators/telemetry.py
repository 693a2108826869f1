"""Latency reports over samples: last-N rings, percentiles, count triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING, EVERY = 4096, 200
STAGES = ("recv_ns", "json_ns", "knn_ns", "send_ns", "total_ns")


def recorded(samples: DataFrame) -> DataFrame:
    """Samples that were timed; others never enter the ring."""
    return samples.where("total_ns > 0")


def newest(samples: DataFrame, n: int = RING) -> DataFrame:
    """The ``n`` newest samples: a top-n, cut per task before it is merged."""
    return samples.orderBy(F.desc("seq")).limit(n)


def percentiles(samples: DataFrame) -> DataFrame:
    """p50, p99 (interpolated, then cut to whole ns) and maximum per stage."""
    long = samples.unpivot(["seq"], list(STAGES), "metric", "ns")
    p = F.percentile("ns", F.array(F.lit(0.5), F.lit(0.99)))
    return long.groupBy("metric").agg(p.alias("p"), F.max("ns").alias("max_ns"), F.count("*").alias("n")).select(
        "metric", F.floor(F.col("p")[0]).alias("p50_ns"), F.floor(F.col("p")[1]).alias("p99_ns"), "max_ns", "n"
    )


def detail(samples: DataFrame) -> DataFrame:
    """Averages and shares of the search counters; one row, nulls without samples."""
    return samples.agg(
        F.avg("clusters_probed").alias("avg_clusters"),
        F.avg("vectors_scanned").alias("avg_vectors"),
        (F.avg("repair_triggered") * 100).alias("repair_pct"),
        (F.avg("early_exit_taken") * 100).alias("early_exit_pct"),
        F.count("*").alias("n"),
    )


def report_points(samples: DataFrame, every: int = EVERY, ring: int = RING, metric: str = "total_ns") -> DataFrame:
    """A report at every ``every``-th sample over the ``ring`` samples up to it.

    A sample takes part in at most ring/every + 1 reports, so it is copied to
    just those and grouped; no report is joined with all samples.
    """
    first = F.ceil(F.col("seq") / every)
    last = F.floor((F.col("seq") + (ring - 1)) / every)
    top = samples.agg(F.floor(F.max("seq") / every).alias("top"))
    copies = (
        samples.crossJoin(F.broadcast(top))  # one row
        .where(first <= F.least(last, F.col("top")))
        .select(F.explode(F.sequence(first, F.least(last, F.col("top")))).alias("report"), metric)
    )
    p = F.percentile(metric, F.array(F.lit(0.5), F.lit(0.99)))
    return copies.groupBy("report").agg(F.count("*").alias("n"), p.alias("p"), F.max(metric).alias("max_ns")).select(
        (F.col("report") * every).alias("seq"), "n", F.floor(F.col("p")[0]).alias("p50_ns"), F.floor(F.col("p")[1]).alias("p99_ns"), "max_ns"
    )


def running_totals(samples: DataFrame) -> DataFrame:
    """Running count and accumulated time, in order of seq.

    Sums per range of seq come first; a range's rows then only need the total
    before it, so no task sorts everything.
    """
    size = F.floor((F.col("seq") - 1) / RING)
    per = samples.groupBy(size.alias("range")).agg(F.count("*").alias("c"), F.sum("total_ns").alias("s"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("range", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s0"))
    own = Window.partitionBy("range").orderBy("seq")
    return (
        samples.withColumn("range", size)
        .join(base, "range")
        .select("seq", (F.col("c0") + F.row_number().over(own)).alias("count"), (F.col("s0") + F.sum("total_ns").over(own)).alias("total_ns"))
    )


def report(samples: DataFrame, ring: int = RING) -> DataFrame:
    """One row over the newest samples: how many there were in all, and per stage
    and counter what ``percentiles`` and ``detail`` say."""
    kept = newest(recorded(samples), ring)
    p = [F.percentile(m, F.array(F.lit(0.5), F.lit(0.99))).alias(m) for m in STAGES]
    top = [F.max(m).alias(f"max_{m}") for m in STAGES]
    shares = [F.avg(c).alias(f"avg_{c}") for c in ("clusters_probed", "vectors_scanned", "repair_triggered", "early_exit_taken")]
    one = kept.agg(F.count("*").alias("kept"), *p, *top, *shares)
    cols = ["seen", "kept"]
    for m in STAGES:
        short = m.removesuffix("_ns")
        cols += [F.floor(F.col(m)[0]).alias(f"{short}_p50_ns"), F.floor(F.col(m)[1]).alias(f"{short}_p99_ns"), F.col(f"max_{m}").alias(f"{short}_max_ns")]
    cols += [F.col("avg_clusters_probed").alias("avg_clusters"), F.col("avg_vectors_scanned").alias("avg_vectors")]
    cols += [(F.col("avg_repair_triggered") * 100).alias("repair_pct"), (F.col("avg_early_exit_taken") * 100).alias("early_exit_pct")]
    return one.crossJoin(recorded(samples).agg(F.count("*").alias("seen"))).select(*cols)  # two single rows


def report_line(reports: DataFrame) -> DataFrame:
    """(line): a report as one line of text, times in milliseconds; for a text sink."""
    parts = [F.format_string("[PERF] N=%d |", "seen")]
    for m in STAGES:
        short = m.removesuffix("_ns")
        ms = [F.col(f"{short}_{k}_ns") / 1e6 for k in ("p50", "p99", "max")]
        shown = F.format_string(f" {short}: p50=%.3f p99=%.3f max=%.3f", *ms)
        parts.append(F.when(F.col("kept") > 0, shown).otherwise(F.lit(f" {short}: N/A")))
    tail = [F.coalesce(c, F.lit(0.0)) for c in ("avg_clusters", "avg_vectors", "repair_pct", "early_exit_pct")]
    parts.append(F.format_string(" | knn_detail: avg_clusters=%.1f avg_vecs=%.1f repair=%.1f%% early_exit=%.1f%%", *tail))
    return reports.select(F.concat(*parts).alias("line"))
