"""The memory of the Python workers, which Spark keeps between the tasks of a session."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, a function for mapInArrow, that gives what it has freed back to the system when its task ends.

    Else Arrow's pool and the C library hold on to it, and an executor pays for every worker that a step before has left
    behind.  Where the C library has no malloc_trim only Arrow's part is given back.
    """
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return task
