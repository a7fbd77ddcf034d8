"""What a Python worker keeps from task to task: one large thing at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa

_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """The worker's own, made once; asking for another frees it."""
    if key not in _held:
        release()
        _held[key] = make()
        trim()
    return _held[key]


def release() -> None:
    """Forget it and give the memory back to the system. Tasks that need much memory of their own begin so, as a worker
    outlives the stage that filled it."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """What Arrow and the C library hold freed goes back to the system, as idle workers keep it else."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that begins with nothing held and leaves no freed memory behind."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        release()
        yield from task(batches)
        trim()

    return run
