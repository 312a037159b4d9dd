"""What a Python worker keeps between tasks, and how it gives memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_HELD: dict[str, object] = {}


def give_back() -> None:
    """Returns freed memory to the system, as other workers and the executor share its bound."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        return


def held(kind: str, key: object, make: Callable[[], object]) -> object:
    """make()'s value, kept for later tasks that ask for the same kind and key. A worker keeps one value: another takes its place."""
    if _HELD.get("kind") != kind or _HELD.get("key") is not key:
        _HELD.clear()
        give_back()
        _HELD.update(kind=kind, key=key, value=make())
    return _HELD["value"]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that gives memory back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
