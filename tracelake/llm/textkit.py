"""Vectorised word handling shared by the corpus operators.

A *word* is a maximal run of characters other than space and ``\\t..\\r``
(``[^\\x20\\x09-\\x0D]+``).  All separators are ASCII, so words are found on
UTF-8 bytes; everything here works on one whole text at a time with numpy, and
its memory is a small multiple of that text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracelake.shared import clear, drop, mark, settle, share  # noqa: F401  for the operators and the pipeline

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, dtype=U64)
_inverse = np.ones(1, dtype=U64)


def _grow(n: int) -> None:
    """Extend the tables of powers of the hash base and of its inverse to n entries."""
    global _powers, _inverse
    if len(_powers) >= n:
        return
    size = 1 << max(12, (n - 1).bit_length())
    mask = (1 << 64) - 1
    for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
        table, step = np.ones(1, dtype=U64), base
        while len(table) < size:
            table = np.concatenate([table, table * U64(step)])
            step = step * step & mask
        globals()[name] = table


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a UTF-8 text start and end."""
    space = _IS_SPACE[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    return edge[0::2], edge[1::2]


class Hasher:
    """64-bit hashes of any byte ranges of one text, in constant time a range."""

    def __init__(self, data: bytes):
        n = len(data)
        _grow(n + 1)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(U64) + U64(1)) * _powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _inverse[start] + (end - start).astype(U64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order."""
    start, end = word_bounds(data)
    return Hasher(data).of(start, end) if len(start) else np.zeros(0, dtype=U64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=U64)
    for i in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def texts(column: pa.Array):
    """The texts of an Arrow string column as bytes, one at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def padding(spark: SparkSession, key: str) -> Column:
    """A second join key that spreads rows with a null key, which meet nothing, over all tasks; 0 for the others.

    It hangs on where a row lies, so the rows should be a written table.
    """
    return F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(partitions(spark))) + 1).otherwise(0)


def trim() -> None:
    """Give back to the system what a task has freed: workers live on between tasks."""
    global _powers, _inverse
    if len(_powers) > 1 << 18:  # a very long text
        _powers, _inverse = np.ones(1, dtype=U64), np.ones(1, dtype=U64)
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if free is not None:
        free(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that trims its worker when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
