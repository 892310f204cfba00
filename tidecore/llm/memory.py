"""Python workers serve many stages: what one of them used is given back before the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For ``mapInArrow``: the same function, leaving no freed memory behind."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_group(run: Callable[[pa.Table], pa.Table]):
    """For ``applyInArrow``: the same function, leaving no freed memory behind."""

    @wraps(run)
    def wrapped(table):
        try:
            return run(table)
        finally:
            give_back()

    return wrapped
