"""Sieves: bitmaps of a join's keys, sent to all tasks, so that rows which the join would drop stay where they are.

A key sets two bits, BITS to a key; some 1 in 250 keys that are not there pass by chance, and the
join itself follows.  A sieve has MOST bits (16 MB) at most; of more keys it passes more rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracelake.functions.workers import trim
from tracelake.shared import share

BITS, MOST = 32, 1 << 27
_BLOCK = 32768  #: bits of one of Spark's bitmaps


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    found = np.ones(len(hashes), dtype=bool)
    for shift in (0, 32):
        at = hashes >> shift & (8 * len(table) - 1)
        found &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def sieve(keys: DataFrame, n: int) -> Callable[[str], Column]:
    """A test of columns by name: false where the value is surely none of the n keys (a settled table of one column)."""
    (key,) = keys.schema
    bits = min(MOST, max(_BLOCK, 1 << (BITS * n).bit_length()))
    hashed = lambda name: F.xxhash64(F.col(name).cast(key.dataType))
    at = F.explode(F.array(*[F.shiftright(hashed(key.name), shift).bitwiseAND(F.lit(bits - 1)) for shift in (0, 32)]))
    blocks = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(_BLOCK - 1))).alias("bits"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for block, part in blocks.collect():
        table[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(part, dtype=np.uint8)
    sent = share(keys.sparkSession, table)

    @arrow_udf("boolean")
    def may_hold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for hashes in batches:
                yield pa.array(_has(sent.value, hashes.to_numpy(zero_copy_only=False)))
        finally:
            trim()

    return lambda name: may_hold(hashed(name))
