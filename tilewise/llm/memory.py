"""Memory that a Python worker no longer needs, given back before its next task."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

#: Tables that modules keep between tasks of one operator.
CACHES: list[dict] = []


def release(but: dict | None = None) -> None:
    """Empty the tables of other operators and return what allocators hold free.

    Workers live on between tasks and stages, beside a JVM in one container.
    """
    for table in CACHES:
        if table is not but:
            table.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


@contextlib.contextmanager
def small_batches(spark, rows: int = 1000):
    """Within it, Python workers of queries that run get at most so many rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
