"""Screens of a ledger's ids: Bloom filters that say of most new ids that they are not there, so that their parts are not read.

A filter is a table of blocks of 32,768 bits, some IDS ids to a block; an id belongs to one block
and sets HASHES bits of it, so looking ids up is one join by block.  Blocks are made and tested
by Spark's bitmap functions.  Each write adds a filter for its ids, before it writes the ids
themselves, so a screen never lacks an id; beyond MOST filters all ids are put into one anew.
An id that a screen knows may yet be absent (some 1 in 10,000): an exact look follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.shared import delete, exists, place

IDS, HASHES, BITS = 1500, 8, 32768
MOST = 16
FOLDER = "_screens"
_SCHEMA = "block long, bits binary"


def _block(name: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(1)), F.lit(blocks)).cast("long")


def _places(name: Column) -> list[Column]:
    one, two = F.xxhash64(name, F.lit(2)).bitwiseAND(F.lit(0xFFFFFFFF)), F.xxhash64(name, F.lit(3)).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.pmod(one + two * i, F.lit(BITS)).cast("long") for i in range(HASHES)]


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0


class Screen:
    """The filters beside a ledger's parts: a folder each, named by its number and its blocks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{FOLDER}"

    def filters(self) -> list[tuple[int, int]]:
        """(number, blocks) of each."""
        if not exists(self.spark, self.path):
            return []
        files, where = place(self.spark, self.path)
        names = [x.getPath().getName() for x in files.listStatus(where)]
        return sorted(tuple(map(int, n.split("-"))) for n in names if exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def add(self, ids: DataFrame, number: int) -> None:
        """A filter of these ids."""
        ids = ids.select("id").distinct()
        blocks = max(1, -(-ids.count() // IDS))
        set_ = ids.select(_block(F.col("id"), blocks).alias("block"), F.explode(F.array(*_places(F.col("id")))).alias("at"))
        set_.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).write.mode("overwrite").parquet(f"{self.path}/{number}-{blocks}")

    def grow(self, ids: DataFrame, number: int, stored: DataFrame | None) -> None:
        """Add ids; where there are too many filters, or none although there are stored ids, one of all."""
        held = self.filters()
        if held and len(held) < MOST or stored is None:
            self.add(ids, number)
            return
        self.add(ids.select("id").unionByName(stored.select("id")), number)
        for old in held:
            delete(self.spark, f"{self.path}/{old[0]}-{old[1]}")

    def may_hold(self, ids: DataFrame) -> DataFrame:
        """Those of the ids (id) that some filter knows."""
        held = self.filters()
        known = ids.select("id").distinct()
        out = []
        for number, blocks in held:  # MOST at most
            rows = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{number}-{blocks}")
            all_set = F.forall(F.array(*_places(F.col("id"))), lambda at: _is_set(F.col("bits"), at))
            out.append(known.join(rows, _block(F.col("id"), blocks) == F.col("block")).where(all_set).select("id"))
        while len(out) > 1:
            out.append(out.pop(0).unionByName(out.pop(0)))
        return out[0].distinct() if out else known.limit(0)
