"""Arrow helpers for tasks: text columns as bytes, in slices of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 18
BATCH_ROWS = 2000


def once_a_process(key: object, make: Callable[[], object]):
    """What ``make`` gives, made once in a worker process and kept until another key is asked for.

    The modules of this package travel with each task, so their globals last one task only.
    """
    kept = sys.__dict__.setdefault("_lotwise_kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Jobs that run inside hand at most ``rows`` rows with texts or sets to Python at once.

    A batch is held by the JVM, outside its heap and in buffers that double, and by the
    worker. The session's own setting holds if it is lower, and again afterwards.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null rows are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), bounds


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text: (first, last, bytes, offsets).

    A row longer than the limit comes alone, whole. Offsets start at zero.
    """
    data, bounds = as_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        low = bounds[first]
        yield first, last, data[low : bounds[last]], bounds[first : last + 1] - low
        first = last


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
