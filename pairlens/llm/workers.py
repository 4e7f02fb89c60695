"""What a Python worker keeps between tasks: bounded, and of one stage only.

Spark reuses its Python workers for the tasks of all stages.  What a stage
keeps here goes when a task of another one begins, and its memory goes back to
the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from functools import wraps

import pyarrow as pa

_kept: dict = {}
_stage: list = [None]


def new_stage() -> None:
    """For the beginning of a task: drops what other stages have kept."""
    from pyspark import TaskContext

    context = TaskContext.get()
    now = context.stageId() if context else None
    if now != _stage[0]:
        _stage[0] = now
        _kept.clear()
        release()


def per_stage(key: Hashable, make: Callable):
    """``make()``, made once by this worker while it works for one stage."""
    new_stage()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run``, a function of a task's batches, that gives back what it has kept
    and freed when it ends: else an idle worker holds its last task's memory
    beside the tasks of the next stages, in which no Python may run."""
    @wraps(run)
    def tidied(batches):
        new_stage()
        yield from run(batches)
        _kept.clear()
        release()

    return tidied
