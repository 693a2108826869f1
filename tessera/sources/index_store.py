"""The index on disk: records partitioned by tag and sorted by cluster."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import kernels
from ..operators.vectorize import quantized
from ..params import DIM, SCALE, SearchParams
from ..runtime import ship, stage
from .requests import read_references

CENTROID_WIDTH = 16
#: Rounds of k-means of a production index.
ROUNDS = 80


@dataclass
class Index:
    records: DataFrame
    clusters: DataFrame
    dim: int = DIM
    centroids: DataFrame | None = None

    @staticmethod
    def build(records: DataFrame, dim: int = DIM, params: SearchParams = SearchParams(), rounds: int = 0, method: str = "lloyd") -> "Index":
        """Clusters from pivots, refined by ``rounds`` Lloyd steps, or from MLlib's
        k-means of ``rounds`` steps at most with ``method="kmeans"``."""
        if method == "kmeans":
            centroids = ix.kmeans(records, params.clusters, dim, rounds or ROUNDS)
        else:
            centroids = ix.lloyd(records, params.clusters, dim, rounds) if rounds else stage(ix.pivots(records, params.clusters), "centroids")
        order = ["tag", "cluster_id", "ref_id"]  # a cluster's records lie together, and a large cluster is split
        assigned = stage(ix.assign(records, centroids, dim), "assigned")
        assigned = stage(assigned.repartitionByRange(*order).sortWithinPartitions(*order), "records")
        return Index(assigned, stage(ix.cluster_table(assigned, centroids, dim), "clusters"), dim, centroids)

    def resident(self) -> "Index":
        """The same index, kept by the executors after its first use."""
        return Index(self.records.persist(), self.clusters.persist(), self.dim, self.centroids)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Searches read one tag's folder and skip row groups by cluster."""
        (
            self.records.repartition("tag", F.pmod("cluster_id", F.lit(64)))
            .sortWithinPartitions("tag", "cluster_id", "ref_id")
            .write.mode(mode)
            .partitionBy("tag")
            .parquet(f"{path}/records")
        )
        self.clusters.write.mode(mode).parquet(f"{path}/clusters")
        if self.centroids is not None:
            self.centroids.write.mode(mode).parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str, dim: int = DIM) -> "Index":
        return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("records", "clusters")), dim, spark.read.parquet(f"{path}/centroids"))

    def size(self) -> int:
        """Records over all partitions, from the cluster table."""
        return self.clusters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def build_index(spark: SparkSession, references: str, path: str, params: SearchParams = SearchParams(), rounds: int | None = None, method: str = "kmeans", mode: str = "errorifexists") -> Index:
    """References (a JSON array, plain or gzip) to an index at ``path``: read, quantize,
    cluster each tag, assign, write; returns the index as it reads back."""
    records = stage(quantized(read_references(spark, references)), "references")
    Index.build(records, DIM, params, ROUNDS if rounds is None else rounds, method).save(path, mode)
    return Index.load(spark, path)


# -- the raw binary layout, one set of files per tag --------------------------


def read_binary(spark: SparkSession, path: str, dim: int = DIM, records_per_task: int = 1 << 18) -> Index:
    """Files ``part{t}_data_i16.bin``, ``_labels.bin``, ``_offsets.bin``, ``_bbox_min_i16.bin``
    and ``_bbox_max_i16.bin`` as an index.

    The path must be one that every executor can open.  Row counts follow from
    the label files' sizes; tasks read ranges of records, not whole files.
    """
    from pyarrow import fs

    base = path if "://" in path else f"file://{path}"
    store, root = fs.FileSystem.from_uri(base)
    jobs = []
    for t in range(4):
        info = store.get_file_info(f"{root}/part{t}_labels.bin")
        if info.type == fs.FileType.File:
            jobs += [(t, a, min(info.size, a + records_per_task)) for a in range(0, info.size, records_per_task)]
    qs = [f"q{i}" for i in range(dim)]

    def load(batches):
        store, root = fs.FileSystem.from_uri(base)

        def part(name: str, start: int, size: int, dtype: str) -> np.ndarray:
            with store.open_input_file(f"{root}/{name}") as f:
                f.seek(start)
                return np.frombuffer(f.read(size), dtype)

        for batch in batches:
            for t, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = part(f"part{t}_data_i16.bin", a * dim * 2, (b - a) * dim * 2, "<i2").reshape(-1, dim).astype(np.int32)
                labels = part(f"part{t}_labels.bin", a, b - a, "u1").astype(np.int32)
                with store.open_input_file(f"{root}/part{t}_offsets.bin") as f:
                    offsets = np.frombuffer(f.read(), "<u4")
                cluster = (np.searchsorted(offsets, np.arange(a, b), "right") - 1).astype(np.int32)
                cols = [np.arange(a, b) * 4 + t, np.full(b - a, t, np.int32), labels, *data.T, cluster]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["ref_id", "tag", "label", *qs, "cluster_id"])

    plan = spark.createDataFrame(jobs or [(0, 0, 0)], "t int, a bigint, b bigint").where("b > a").repartition(max(1, len(jobs)))
    schema = f"ref_id bigint, tag int, label int, {', '.join(f'{q} int' for q in qs)}, cluster_id int"
    boxes = []
    for t in sorted({t for t, _, _ in jobs}):
        with store.open_input_file(f"{root}/part{t}_offsets.bin") as f:
            offsets = np.frombuffer(f.read(), "<u4").astype(np.int64)
        lows, highs = (np.frombuffer(store.open_input_file(f"{root}/part{t}_bbox_{m}_i16.bin").read(), "<i2").reshape(-1, dim) for m in ("min", "max"))
        for c in range(len(offsets) - 1):
            mixed = [int(x) for i in range(dim) for x in (lows[c, i], highs[c, i])]
            boxes.append((t, c, int(offsets[c + 1] - offsets[c]), int(offsets[c]), *mixed))
    box_cols = ", ".join(f"mn{i} int, mx{i} int" for i in range(dim))
    clusters = spark.createDataFrame(boxes, f"tag int, cluster_id int, n bigint, offset bigint, {box_cols}")
    return Index(plan.mapInArrow(load, schema), clusters, dim)


def write_binary(index: Index, path: str) -> None:
    """The files that ``read_binary`` reads, and ``part{t}_centroids.bin``.

    Each cluster's records are written by one task as a piece at its place; the
    pieces of a tag are then put together in order.  Only the tables of clusters,
    which the parameters bound, pass through this process.
    """
    from pyarrow import fs

    spark, dim = index.records.sparkSession, index.dim
    ship(spark)
    base = path if "://" in path else f"file://{path}"
    store, root = fs.FileSystem.from_uri(base)
    store.create_dir(f"{root}/.pieces", recursive=True)
    qs = kernels.codes(index.records, dim)

    def write(batches):
        store, root = fs.FileSystem.from_uri(base)
        for part in kernels.chunks(batches, 1 << 18):
            tags, cells = kernels.column(part, "tag"), kernels.column(part, "cluster_id")
            codes, labels = kernels.matrix(part, dim).astype("<i2"), kernels.column(part, "label").astype("u1")
            for t, c in sorted(set(zip(tags.tolist(), cells.tolist(), strict=True))):
                own = (tags == t) & (cells == c)
                first = int(kernels.column(part, "ref_id")[own][0]) & (1 << 64) - 1
                name = f"{root}/.pieces/{t}-{c:08d}-{first ^ 1 << 63:020d}"
                for kind, data in (("data", codes[own]), ("labels", labels[own])):
                    with store.open_output_stream(f"{name}.{kind}") as f:  # the same bytes if the task runs again
                        f.write(data.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([name])], ["tag", "piece"])

    placed = index.records.repartition("tag", "cluster_id").sortWithinPartitions("tag", "cluster_id", "ref_id")
    pieces = placed.select("ref_id", "tag", "label", "cluster_id", *qs).mapInArrow(write, "tag int, piece string").distinct().collect()
    for t, (_, low, high, n) in ix.by_tag(index.clusters, dim, "mn", "mx", "n").items():
        names = sorted(p["piece"] for p in pieces if p["tag"] == t)
        for kind, file in (("data", "data_i16"), ("labels", "labels")):
            with store.open_output_stream(f"{root}/part{t}_{file}.bin") as out:
                for name in names:
                    with store.open_input_stream(f"{name}.{kind}") as f:
                        while block := f.read(1 << 20):
                            out.write(block)
        tables = {"offsets": np.concatenate([[0], np.cumsum(n)]).astype("<u4"), "bbox_min_i16": low.astype("<i2"), "bbox_max_i16": high.astype("<i2")}
        if index.centroids is not None:
            centers = ix.by_tag(index.centroids, dim, "q")[t][1] / SCALE
            tables["centroids"] = np.pad(centers, ((0, 0), (0, CENTROID_WIDTH - dim))).astype("<f4")
        for name, data in tables.items():
            with store.open_output_stream(f"{root}/part{t}_{name}.bin") as out:
                out.write(data.tobytes())
    store.delete_dir(f"{root}/.pieces")
