"""Running functions over Arrow batches in Python workers."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in workers that can import this package and give back memory after each task.

    The package's root is named in the workers' module path, as ``--py-files`` does for a submitted
    job.  Workers live on from task to task; what a task has freed goes back to the system, so
    that idle workers of an executor stay small.
    """
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory of Arrow and of the C library, where it can be told to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
