"""Memory of Python workers, which Spark keeps from task to task and from query to query."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(worker: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The worker function, giving memory back when its partition is done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from worker(batches)
        finally:
            give_back()
    return run


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by ``BATCH_BYTES``, if they may be larger; long texts
    otherwise take several times the default of 64 MB in the JVM and in every worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and not 0 < _bytes(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.strip().lower()
    number = text.rstrip("bkmg")
    unit = text[len(number):][:1]
    return int(number) * units.get(unit or "b", 1)
