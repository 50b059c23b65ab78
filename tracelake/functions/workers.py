"""What Python workers hold: batches are worked off in short slices, and a task gives back what it has freed when it ends.

Workers live on between tasks, several to a core where a stage has several functions, so what
each keeps adds up within an executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of a batch that are worked off at a time.
SLICE = 1 << 20


def slices(batch, most: int = SLICE) -> Iterator:
    """A batch, or an array, in slices of about so many bytes, of a row at least."""
    rows = len(batch) if isinstance(batch, pa.Array) else batch.num_rows
    step = max(1, rows * most // max(1, batch.nbytes))
    for i in range(0, rows, step):
        yield batch.slice(i, step)


def trim() -> None:
    """Give back to the system what has been freed."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if free is not None:
        free(0)


def trimmed(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A task's function over record batches that sees them in slices, and trims its worker when it ends."""

    def wrapped(batches):
        try:
            yield from run(s for b in batches for s in slices(b))
        finally:
            trim()

    return wrapped
