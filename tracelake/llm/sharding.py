"""Operator 11: shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: ``jump`` walks the
numbers of shards at which the key would move, by a pseudo-random sequence that the key
seeds, up to the number asked for.  There is no table of a ring to keep or to send, and
when a shard is appended a key either stays or moves into the new one, one in as many as
there are shards then.

``shard_of`` is that as a column; ``sharded`` lists rows with shard, place within the
shard and the shard after one more is appended; ``write_shards``, ``append_shard`` and
``read_shards`` keep the rows themselves in folders of which growth writes the new one only.

A null key is a key like any other and falls where -1 does, so all rows with a null key
share a shard; rows that repeat a key do too.  Null texts have no bytes.  Empty tables give
empty results, and columns that are not needed are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.textkit import U64, mix, settle

#: Fixed values of the method: the multiplier of its generator and how many bits a draw leaves out.
MULTIPLIER, LOW_BITS = 2862933555777941757, 33


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of each 64-bit key; about log(shards) steps, over the keys that still move."""
    keys = keys.astype(U64)
    at, to, left = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
    while len(left):
        at[left] = to[left]
        keys[left] = keys[left] * U64(MULTIPLIER) + U64(1)
        draw = (keys[left] >> U64(LOW_BITS)).astype(np.float64) + 1
        to[left] = ((at[left] + 1) * (2.0**31 / draw)).astype(np.int64)
        left = left[to[left] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a whole number; its bits are mixed first, since ids lie in a row or by steps."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(mix(keys.to_numpy(dtype=np.int64).view(U64)), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(-1)))


def key_of(docs: DataFrame, key: str) -> Column:
    """A whole number for a key column of any type: itself, or its hash."""
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))


def placed(rows: DataFrame, shard: str, by: list[str]) -> DataFrame:
    """The rows with a column slot: how many rows of the same shard come before, in the order of by, nulls first.

    Rows are dealt by ranges of (shard, by), which a running number splits where many rows
    tie; a task numbers its own, and what the tasks before it hold of a shard, a row for each
    task and shard, is added.  So no shard meets in one task, and slots depend on the rows
    alone, however they lie.  Rows that tie on by get their slots in any order.
    """
    columns = rows.columns
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shard, *by, "_tie").sortWithinPartitions(shard, *by)
    i = columns.index(shard)

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(0, dtype=np.int64)
        for b in batches:
            s = b.column(i).to_numpy()
            if not len(s):
                continue
            seen = np.concatenate([seen, np.zeros(max(0, int(s.max()) + 1 - len(seen)), dtype=np.int64)])
            local = seen[s] + np.arange(len(s)) - np.searchsorted(s, s)
            seen += np.bincount(s, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), part, dtype=np.int32)), pa.array(local)], [*columns, "_part", "_local"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = settle(spread.select(*columns).mapInArrow(number, f"{kinds}, _part int, _local long"), "shard-slots")
    counts = numbered.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # ranges follow on each other, so there are at most as many counts as tasks and shards together
    return numbered.join(F.broadcast(counts), [shard, "_part"]).select(*columns, (F.col("_before") + F.col("_local")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row; texts stay where they are.

    size is the text's bytes plus 1, text_crc32 the unsigned checksum of its UTF-8 bytes, law
    says "key", grown_shard is the shard with one more; slots follow key, size and checksum.
    Repeated rows give a row each.
    """
    text, number = F.coalesce(F.col("text"), F.lit("")), key_of(docs, key)
    rows = docs.select(
        key, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), shard_of(number, shards).alias("shard"), shard_of(number, shards + 1).alias("grown_shard")
    )
    return placed(rows, "shard", [key, "size", "text_crc32"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", pieces: int = 1) -> None:
    """Write the rows below path, in a folder shard=N each, in about so many files a shard.

    Rows of a shard are dealt to its files by a running number, so a hot key makes no large
    file.  A column named shard gives way.
    """
    rows = docs.drop("shard").withColumn("shard", shard_of(key_of(docs, key), shards))
    rows = rows.withColumn("_piece", F.pmod(F.monotonically_increasing_id(), F.lit(pieces)))
    rows.repartition("shard", "_piece").drop("_piece").write.partitionBy("shard").mode("overwrite").parquet(path)


def append_shard(spark: SparkSession, path: str, shards: int, key: str = "doc_id") -> None:
    """Add shard number ``shards`` to as many: the rows that move are written there, and nothing else is.

    The old folders keep what has moved; read_shards with the new number passes it over.  So
    running this again does no harm, and readers of the old number are not disturbed.
    """
    rows = read_shards(spark, path, shards, key)
    moved = rows.where(shard_of(key_of(rows, key), shards + 1) == shards).drop("shard")
    moved.write.mode("overwrite").parquet(f"{path.rstrip('/')}/shard={shards}")


def read_shards(spark: SparkSession, path: str, shards: int, key: str = "doc_id") -> DataFrame:
    """The rows with their shard, for the number of shards given: rows that lie in a folder of another number are passed over."""
    rows = spark.read.parquet(path).where(F.col("shard") < shards)
    return rows.where(F.col("shard") == shard_of(key_of(rows, key), shards))
