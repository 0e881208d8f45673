"""What Spark's Python workers hold when a task is through.

Spark keeps workers for later tasks, and a step with several Python stages has some for each core, so what each of them holds on
to counts several times beside the executor's heap: memory that was freed but stays with the C library or Arrow, and the
tokenizer of a step that ended long ago.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

from . import tokens


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(of_batches: Callable, encoding: bool = False) -> Callable:
    """``of_batches`` for mapInArrow; after its last batch the worker gives memory back.

    ``encoding``: it uses a tokenizer, which stays open for its next task; else one that is open is closed first."""

    def run(batches):
        if not encoding:
            tokens.close()
        try:
            yield from of_batches(batches)
        finally:
            give_back()

    return run
