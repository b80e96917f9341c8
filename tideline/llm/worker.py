"""What a Python worker remembers between tasks, and giving it back when the worker turns to another operator."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: Called when a worker turns to another operator: each empties a cache.
caches: list[Callable[[], None]] = []
_serving = ""


def turn_to(operator: str) -> None:
    """Empties the caches that other operators have filled in this process, and returns free memory to the system."""
    global _serving
    if operator == _serving:
        return
    _serving = operator
    for empty in caches:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def serves(operator: str):
    """For functions from batches to batches: a worker that runs one keeps no memory of other operators."""

    def wrap(f):
        @wraps(f)
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn_to(operator)
            yield from f(batches)

        return work

    return wrap
