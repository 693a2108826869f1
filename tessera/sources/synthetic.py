"""A repeatable workload: vectors from a linear congruential generator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship

#: Multiplier, increment, modulus, first state, and width of a vector (fixed values).
FACTOR, ADDEND, MODULUS, FIRST, WIDTH = 1664525, 1013904223, 1 << 32, 0x12345678, 16


def states(steps: np.ndarray) -> np.ndarray:
    """The generator's state after each number of steps, without going through the
    steps before: the step is an affine map, so 2^k steps are one too."""
    x = np.full(len(steps), FIRST, np.uint64)
    a, c, mask = FACTOR, ADDEND, np.uint64(MODULUS - 1)
    for k in range(int(steps.max(initial=0)).bit_length()):
        on = (steps >> k & 1).astype(bool)
        x[on] = (x[on] * np.uint64(a) + np.uint64(c)) & mask
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return x


def synthetic_queries(spark: SparkSession, rows: int = 500, width: int = WIDTH) -> DataFrame:
    """(qid, place, state, value): ``rows`` vectors with values in [0, 1) from the state's upper 24 bits.

    Every task computes its own rows; the sequence is that of one generator.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            qid = batch.column(0).to_numpy()
            place = np.tile(np.arange(width), len(qid))
            qid = np.repeat(qid, width)
            x = states(qid * width + place + 1)
            cols = [qid, place.astype(np.int32), x.astype(np.int64), (x >> np.uint64(8)).astype(np.float32) / np.float32(1 << 24)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["qid", "place", "state", "value"])

    return spark.range(rows).withColumnRenamed("id", "qid").mapInArrow(run, "qid bigint, place int, state bigint, value float")
