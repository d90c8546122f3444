"""What a Python worker does besides the rows of its task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Free memory goes back to the system: allocators keep it for a next task, which another worker may get."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):            # another C library: nothing to ask it for
        pass


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, whose memory is given back when it is done: a worker
    waits for its next task beside those that work."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task
