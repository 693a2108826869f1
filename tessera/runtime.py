"""Session settings, and shipping of this package to executors."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from itertools import chain
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Settings that results depend on; the rest is left to the cluster.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}
#: Rows are whole texts, so the default of 10,000 a batch would take too much memory.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
#: Bytes of a row group that a task writes.
_ROW_GROUP = 4 << 20
#: Partitions per core up to which small tables are written by Python.
_TASKS_PER_CORE = 16


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (REQUIRED | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application.

    Python workers import it by name; a cluster need not have it installed.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on this machine (tests) a
    temporary folder is made and used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted by the scope around the call
    or when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}/{name}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    made = _SCOPE.get()
    if made is not None:
        made.folders.append(str(folder))
    return path


class Scratch:
    """Scratch folders made inside one ``scratch_scope``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def release(self, *still_read: DataFrame) -> None:
        """Delete the folders made so far, but for those that ``still_read`` reads."""
        read = {f.split("/tessera/", 1)[1].split("/", 1)[0] for df in still_read for f in df.inputFiles() if "/tessera/" in f}
        for folder in [f for f in self.folders if f.rsplit("/", 1)[1] not in read]:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)
            fs.cancelDeleteOnExit(path)
            self.folders.remove(folder)


_SCOPE: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scratch]:
    """Collects the scratch folders made inside, and only those; what is left at
    the end belongs to the scope around it."""
    outer, own = _SCOPE.get(), Scratch(spark)
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        if outer is not None:
            outer.folders += own.folders


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker outlives its tasks, and
    what one task needed once would else be held beside the next one's needs."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def stage_small(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for tables of a few megabytes a task: without Hadoop's committer,
    which takes longer than their rows.  Where partitions are far more than cores,
    starting Python for each takes longer still, and the committer is used."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.shuffle.partitions")) > _TASKS_PER_CORE * spark.sparkContext.defaultParallelism:
        return stage(df, name)
    return stage_arrow(df, lambda batches: batches, df.schema, name)


def stage_arrow(df: DataFrame, fn, schema: str | StructType, name: str) -> DataFrame:
    """``stage`` of ``df.mapInArrow(fn, schema)``, whose tasks write their batches
    themselves instead of handing them back to the JVM.

    A task writes one file under a name of its attempt and renames it to that of
    its partition, so a second attempt leaves the same file.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    try:
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
    except (pa.ArrowInvalid, OSError):  # a store that only Spark can open
        df.mapInArrow(fn, schema).write.option("compression", "zstd").parquet(path)
        return spark.read.schema(schema).parquet(path)

    def write(batches):
        made = iter(fn(batches))
        first = next(made, None)
        if first is None:
            return
        ctx = TaskContext.get()
        store, root = filesystem(path)
        part = f"{root}/.part-{ctx.partitionId():08d}.{ctx.taskAttemptId()}.{uuid.uuid4().hex}"
        held, size, rows = [], 0, 0
        with store.open_output_stream(part) as sink, pq.ParquetWriter(sink, first.schema, compression="zstd", use_dictionary=False) as out:
            for batch in chain([first], made):
                held.append(batch)
                size, rows = size + batch.nbytes, rows + batch.num_rows
                if size >= _ROW_GROUP:
                    out.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                out.write_table(pa.Table.from_batches(held))
        store.move(part, f"{root}/part-{ctx.partitionId():08d}.parquet")
        held = first = batch = None
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.mapInArrow(write, "rows bigint").agg(F.sum("rows")).collect()
    return spark.read.schema(schema).parquet(path)


def filesystem(uri: str):
    """(file system, path) of an address in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
