"""Sums of the vectors that tasks leave, over executors: by pieces of the vector, in two steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a piece; groups that the tasks' pieces are first added up in.
PIECE, GROUPS = 1 << 14, 32
SCHEMA = "piece int, part int, sums binary"


def pieces(vector: np.ndarray) -> pa.RecordBatch:
    """A task's vector (float64), cut into ranges."""
    vector = np.ascontiguousarray(vector, dtype=np.float64)
    cut = [vector[i : i + PIECE].tobytes() for i in range(0, len(vector), PIECE)]
    part = TaskContext.get().partitionId() % GROUPS
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array(cut, pa.binary())], names=["piece", "part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for piece, part, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(value)
            sums[piece, part] = sums[piece, part] + x if (piece, part) in sums else x
    keys = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["piece", "part", "sums"])


def summed(parts: DataFrame, reducers: int = 8) -> np.ndarray | None:
    """The sum of the vectors whose pieces() the tasks left; None if there are none.

    Pieces meet by range and group first, then by range: neither the driver nor a task gets a vector from
    every task. The driver gets the sum alone.
    """
    once = parts.repartition(reducers, "piece", "part").mapInArrow(_added, SCHEMA).withColumn("part", F.lit(0))
    found = once.repartition(reducers, "piece").mapInArrow(_added, SCHEMA).collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.piece)]) if found else None
