"""Memory that a Python worker has freed goes back to the system.

Spark keeps a task's Python workers for later tasks.  Their allocators keep what
was freed as well, so workers that wait would hold the peak of an earlier stage
beside the memory of the stage that runs.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

LEAST_S = 0.5  # between two returns inside a task
_last = 0.0


def give_back(least: float = 0.0) -> None:
    """Return freed memory, unless that was done less than ``least`` seconds ago."""
    global _last
    if time.monotonic() - _last < least:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    _last = time.monotonic()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, with memory given back between batches and at the end of the task."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                del batch
                give_back(LEAST_S)
        finally:
            give_back()

    return lean


def released_group(run: Callable[[tuple, pa.Table], pa.Table]):
    """``run`` for ``applyInArrow``, with memory given back after a group."""

    def lean(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        give_back(LEAST_S)
        return out

    return lean


def released_pair(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]):
    """``run`` for ``applyInArrow`` of two tables, with memory given back after a group."""

    def lean(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        give_back(LEAST_S)
        return out

    return lean
