"""Memory of Python workers: how much of a table they get at once, and returning it between tasks of a reused worker."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows in a batch. Spark's own bound of 64 MB is held several times over for each task of an executor: as vectors, as
#: bytes on their way to the worker, and in the worker with what is made of them.
BATCH = 8 << 20


def map_texts(rows: DataFrame, run: Callable, kinds: str) -> DataFrame:
    """``rows.mapInArrow(run, kinds)`` in batches of about ``BATCH`` bytes, however long the texts are.

    Spark reads the bound when it plans a query, which may be later, so it stays set in the session. One that is set already stays as it is.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, str(BATCH))
    return rows.mapInArrow(run, kinds)


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and an executor's limit covers all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
