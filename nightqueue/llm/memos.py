"""What operators remember in a Python worker: only the operator that ran last keeps it.

Spark gives its Python workers to one operator after another. Without this, a worker would hold the
memos of all operators that it ever ran."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa

#: glibc's number of that setting, and bytes.
M_MMAP_THRESHOLD, LARGE = -3, 1 << 18

_LAST: list[tuple[str, Callable[[], None]]] = []


def take(owner: str, forget: Callable[[], None]) -> None:
    """Makes `owner` the operator that may remember; another one before it is told to forget."""
    if _LAST and _LAST[0][0] != owner:
        _LAST.pop()[1]()
        give_back()
    if not _LAST:
        _LAST.append((owner, forget))


def give_back() -> None:
    """Returns what is free to the system: allocators keep freed memory, and an executor's other workers count against one limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(1)
def hand_back_large() -> None:
    """From now on arrays of over LARGE bytes go back to the system when they are freed, each on its own.

    glibc raises that size by itself, up to 32 MB, after which a batch's arrays stay with the worker between others that live on."""
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, LARGE)
