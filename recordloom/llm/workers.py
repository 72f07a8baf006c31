"""Memory manners of Python workers, which stay alive and idle between tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(run):
    """``run`` over Arrow batches, with its memory handed back when it ends."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner
