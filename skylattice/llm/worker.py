"""Memory of Python workers, which Spark reuses from stage to stage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """The worker's one large memo: what ``make`` gave for ``key``. A memo of another kind is given up first, so that a
    worker that has served several operators holds the memo of the last one only."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def released(batches: Iterable) -> Iterator:
    """``batches``, and after the last one what the task has freed goes back to the system: workers live on, and several
    of them share an executor's memory."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
