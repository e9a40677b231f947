"""Memory of Python workers: the size of the batches they get, and what they keep when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, whatever its rows: one of very long texts is no larger than others.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts are long: Arrow batches of fewer rows and bytes than Spark's default keep executors' memory down.
    What a query returns is lazy, so the settings stay with the session; smaller ones are left alone."""
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(most, str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(run):
    """run() as a function for mapInArrow whose worker gives memory back to the system when a task ends:
    workers stay, and else each would keep the most it ever used."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
