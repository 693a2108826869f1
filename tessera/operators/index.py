"""Building the inverted-file index: partitions, clusters, boxes, offsets.

Records: (ref_id, tag, label, q).  Clusters: (tag, cluster_id, n, offset, mn, mx).
Vectors are arrays, or columns q0.., mn0.. and mx0..; both forms go everywhere.
An empty cluster keeps an inverted box, so it ranks last but takes part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..params import SCALE
from ..runtime import ship
from . import kernels

EMPTY_MIN, EMPTY_MAX = 32767, -32768


def partition_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("tag").agg(F.count("*").alias("n"))


def pivots(records: DataFrame, clusters: int) -> DataFrame:
    """The first ``clusters`` records of each tag as centroids.

    The rank filter is pushed below the shuffle (group limit), so a tag sends
    ``clusters`` rows per task at most.
    """
    w = Window.partitionBy("tag").orderBy("ref_id")
    return records.withColumn("cluster_id", F.row_number().over(w) - 1).where(F.col("cluster_id") < clusters).drop("label", "ref_id")


def by_tag(table: DataFrame, dim: int, *prefixes: str) -> dict[int, tuple]:
    """{tag: (cluster ids, matrix or column for each prefix)} of a table of
    clusters x tags rows, which the parameters bound; ids ascend."""
    wide = [c for p in prefixes for c in (["n"] if p == "n" else kernels.codes(table, dim, p))]
    rows = table.select("tag", "cluster_id", *wide).toArrow().sort_by([("tag", "ascending"), ("cluster_id", "ascending")])
    tags = kernels.column(rows, "tag")
    out = {}
    for t in np.unique(tags).tolist():
        own = rows.filter(pa.array(tags == t))
        out[t] = (kernels.column(own, "cluster_id"), *(kernels.column(own, p) if p == "n" else kernels.matrix(own, dim, p) for p in prefixes))
    return out


def distances(records: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """(ref_id, cluster_id, dist): every record against every centroid of its tag."""
    ship(records.sparkSession)
    known = by_tag(centroids, dim, "q")

    def run(batches):
        for part in kernels.chunks(batches):
            tags, ids, q = kernels.column(part, "tag"), kernels.column(part, "ref_id"), kernels.matrix(part, dim)
            for t in np.unique(tags).tolist():
                if t not in known:
                    continue
                at, (clusters, centers) = np.flatnonzero(tags == t), known[t]
                d = kernels.squared(q[at], centers).astype(np.int64)
                cols = [np.repeat(ids[at], len(clusters)), np.tile(clusters, len(at)), d.ravel()]
                yield from pa.Table.from_arrays([pa.array(c) for c in cols], ["ref_id", "cluster_id", "dist"]).to_batches(1 << 16)

    return records.select("ref_id", "tag", *kernels.codes(records, dim)).mapInArrow(run, "ref_id bigint, cluster_id int, dist bigint")


def assign(records: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """``records`` with the nearest centroid of their tag; ties to the lower id.

    Centroids go to the tasks, records stay where they are: no shuffle.
    """
    ship(records.sparkSession)
    known = by_tag(centroids, dim, "q")

    def run(batches):
        for part in kernels.chunks(batches):
            tags, q = kernels.column(part, "tag"), kernels.matrix(part, dim)
            best, dist = np.full(len(tags), -1, np.int32), np.zeros(len(tags), np.int64)
            for t in np.unique(tags).tolist():
                if t in known:
                    at, (clusters, centers) = np.flatnonzero(tags == t), known[t]
                    d = kernels.squared(q[at], centers)
                    least = d.argmin(axis=1)
                    best[at], dist[at] = clusters[least], d[np.arange(len(at)), least].astype(np.int64)
            done = part.append_column("cluster_id", pa.array(best)).append_column("dist", pa.array(dist))
            yield from done.filter(pa.array(best >= 0)).to_batches(1 << 14)

    narrow = records.select("ref_id", "tag", "label", *kernels.codes(records, dim))
    return narrow.mapInArrow(run, StructType([*narrow.schema.fields, StructField("cluster_id", IntegerType()), StructField("dist", LongType())]))


def _per_place(assigned: DataFrame, dim: int, **sums) -> DataFrame:
    """(tag, cluster_id, n, and an array over the dimensions for each of ``sums``).

    A row per dimension keeps the aggregate narrow; it combines before the shuffle.
    """
    long = assigned.select("tag", "cluster_id", F.posexplode("q").alias("i", "x"))
    per = long.groupBy("tag", "cluster_id", "i").agg(F.count("*").alias("n"), *[f("x").alias(name) for name, f in sums.items()])
    rows = F.sort_array(F.collect_list(F.struct("i", *sums)))
    done = per.groupBy("tag", "cluster_id").agg(F.max("n").alias("n"), rows.alias("rows"))
    return done.select("tag", "cluster_id", "n", *[F.col(f"rows.{name}").alias(name) for name in sums])


def cluster_table(assigned: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """Counts, offsets and boxes of all clusters, the empty ones included."""
    before = Window.partitionBy("tag").orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    places = [F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")]
    empty = {"mn": EMPTY_MIN, "mx": EMPTY_MAX}
    if "q" in assigned.columns:
        found = _per_place(assigned, dim, mn=F.min, mx=F.max)
        full = centroids.select("tag", "cluster_id").join(found, ["tag", "cluster_id"], "left")
        return full.select("tag", "cluster_id", *places, *[F.coalesce(p, F.array_repeat(F.lit(x), dim)).alias(p) for p, x in empty.items()])
    boxes = [f(f"q{i}").alias(f"{p}{i}") for i in range(dim) for f, p in ((F.min, "mn"), (F.max, "mx"))]
    found = assigned.groupBy("tag", "cluster_id").agg(F.count("*").alias("n"), *boxes)
    full = centroids.select("tag", "cluster_id").join(found, ["tag", "cluster_id"], "left")
    return full.select(
        "tag",
        "cluster_id",
        *places,
        *[F.coalesce(f"{p}{i}", F.lit(empty[p])).alias(f"{p}{i}") for i in range(dim) for p in ("mn", "mx")],
    )


def cluster_means(assigned: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """One Lloyd step: mean per cluster (m), or the old centroid where it is empty."""
    if "q" in assigned.columns:
        both = centroids.join(_per_place(assigned, dim, s=F.sum), ["tag", "cluster_id"], "left")
        mean = F.transform("s", lambda x: x / F.col("n"))
        old = F.transform("q", lambda x: x.cast("double"))
        return both.select("tag", "cluster_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(mean, old).alias("m"))
    sums = assigned.groupBy("tag", "cluster_id").agg(F.count("*").alias("n"), *[F.sum(f"q{i}").alias(f"s{i}") for i in range(dim)])
    both = centroids.join(sums, ["tag", "cluster_id"], "left")
    return both.select(
        "tag",
        "cluster_id",
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.coalesce(F.col(f"s{i}") / F.col("n"), F.col(f"q{i}").cast("double")).alias(f"m{i}") for i in range(dim)],
    )


def lloyd(records: DataFrame, clusters: int, dim: int, rounds: int) -> DataFrame:
    """``rounds`` Lloyd steps from pivots; centroids are rounded to the code grid.

    A round's centroids have clusters x tags rows, so they are gathered and
    handed to the next round as a local table: the plan doesn't grow.
    """
    spark = records.sparkSession
    centroids = pivots(records, clusters)
    for _ in range(rounds):
        means = cluster_means(assign(records, centroids, dim), centroids, dim)
        if "m" in means.columns:
            step = means.select("tag", "cluster_id", F.transform("m", lambda x: F.round(x).cast("int")).alias("q"))
        else:
            step = means.select("tag", "cluster_id", *[F.round(f"m{i}").cast("int").alias(f"q{i}") for i in range(dim)])
        centroids = spark.createDataFrame(step.collect(), step.schema)
    return centroids


def positions(assigned: DataFrame) -> DataFrame:
    """Place of each record in its cluster and its partition, in stable order.

    A partition's place is its cluster's plus the sizes of the clusters before, a
    table of clusters x tags rows; no task sorts a whole partition.
    """
    in_cluster = Window.partitionBy("tag", "cluster_id").orderBy("ref_id")
    before = Window.partitionBy("tag").orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = assigned.groupBy("tag", "cluster_id").agg(F.count("*").alias("n"))
    offsets = sizes.select("tag", "cluster_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = assigned.select("ref_id", "tag", "cluster_id", (F.row_number().over(in_cluster) - 1).alias("pos_in_cluster"))
    return placed.join(F.broadcast(offsets), ["tag", "cluster_id"]).select(
        "ref_id", "tag", "cluster_id", "pos_in_cluster", (F.col("before") + F.col("pos_in_cluster")).alias("pos_in_tag")
    )


def kmeans(records: DataFrame, clusters: int, dim: int, rounds: int = 80, seed: int = 42) -> DataFrame:
    """Centroids per tag by MLlib k-means on the dequantized vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    one = F.col("q") if "q" in records.columns else F.array(*[f"q{i}" for i in range(dim)])
    scaled = F.transform(one, lambda x: x / F.lit(float(SCALE)))
    vectors = records.select("tag", array_to_vector(scaled).alias("features"))
    spark, rows = records.sparkSession, []
    for r in records.groupBy("tag").count().orderBy("tag").collect():  # four tags at most
        own = vectors.where(F.col("tag") == r["tag"])
        model = KMeans(k=min(clusters, r["count"]), maxIter=rounds, tol=0.0, initMode="random", seed=seed + r["tag"]).fit(own)
        for c, center in enumerate(model.clusterCenters()):
            rows.append((r["tag"], c, [int(round(float(x) * SCALE)) for x in center]))
    made = spark.createDataFrame(rows, "tag int, cluster_id int, q array<int>")
    return made if "q" in records.columns else made.select("tag", "cluster_id", *[F.col("q")[i].alias(f"q{i}") for i in range(dim)])
