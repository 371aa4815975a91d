"""Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Rows that are Python objects at a time.
ROWS = 500


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and what they keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ROWS, so that few texts are Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)
    give_back()
