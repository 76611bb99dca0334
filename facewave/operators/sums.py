"""Sums of vectors over the rows of a table, by keys that follow a model and not the rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions whose sums the driver adds up by itself; those of more are added up in groups before.
DIRECT = 16


def added(table: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], parts: int) -> dict[int, np.ndarray]:
    """The vectors that ``work`` makes of each of the ``parts`` partitions, added up by key. The driver gets those of ``DIRECT`` partitions, or of as many groups as the root of ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        for k, s in work(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([k], pa.int64()), pa.array([np.ascontiguousarray(s, float).tobytes()], pa.binary())], ["at", "k", "s"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"k": group["k"].slice(0, 1), "s": pa.array([sum(np.frombuffer(s.as_buffer(), float) for s in group["s"]).tobytes()], pa.binary())})

    sums = table.mapInArrow(run, "at long, k long, s binary")
    if parts > DIRECT:
        sums = sums.groupBy("k", F.pmod("at", F.lit(math.isqrt(parts)))).applyInArrow(add, "k long, s binary")
    out: dict[int, np.ndarray] = {}
    got = sums.select("k", "s").toArrow()
    for k, s in zip(got["k"].to_pylist(), got["s"].to_pylist(), strict=True):
        out[k] = out.get(k, 0) + np.frombuffer(s, float)
    return out
