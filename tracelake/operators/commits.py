"""Writers of one ledger kept apart: a numbered commit for each write, claimed before anything is changed.

Beside a ledger's parts lies the folder _commits.  A write reads the last number, makes what
it will write, claims the next number by creating its file, which fails where another writer
was first, then writes, and marks the commit done.  So of two writers that have read the same
state one wins, and the other reads anew.  A claim says what it is about to do: a rewrite names
a copy of the new parts that lies ready, so if its writer is lost, whoever comes next after
PATIENCE finishes it; an append that was lost is marked done, since sending it again adds what lacks.

The claim is as exclusive as the file system's create without overwriting.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.operators.screens import Screen
from tracelake.shared import delete, exists, place, scope, settle

#: Seconds that a writer waits for another's commit before it finishes that itself, and between looks.
PATIENCE, PAUSE = 60.0, 0.2
#: How often a write is made anew after others were first.
ATTEMPTS = 20
FOLDER = "_commits"


class Conflict(Exception):
    """Another writer was first."""


class Commits:
    """The commits of a ledger at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.folder = place(spark, f"{self.path}/{FOLDER}")

    def _file(self, number: int, end: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder, f"{number:012d}.{end}")

    def last(self) -> int:
        """The number of the last commit that was claimed; 0 before the first."""
        if not self.files.exists(self.folder):
            return 0
        return max((int(x.getPath().getName()[:12]) for x in self.files.listStatus(self.folder)), default=0)

    def ready(self, patience: float | None = None) -> int:
        """The number of the last commit once it is done; one that stays undone for so long is finished here."""
        end = time.time() + (PATIENCE if patience is None else patience)
        while True:
            number = self.last()
            if not number or self.files.exists(self._file(number, "done")):
                return number
            if time.time() >= end:
                self.finish(number)
                return number
            time.sleep(PAUSE)

    def claim(self, number: int, what: dict) -> None:
        try:
            out = self.files.create(self._file(number, "claim"), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"commit {number} of {self.path}") from None
            raise
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()

    def done(self, number: int) -> None:
        self.files.create(self._file(number, "done"), True).close()

    def finish(self, number: int) -> None:
        """Do what the claim of a lost writer says, which may have been done in part, and mark it done."""
        status = self.files.getFileStatus(self._file(number, "claim"))
        stream = self.files.open(self._file(number, "claim"))
        try:
            text = bytes(stream.readNBytes(int(status.getLen()))).decode()
        finally:
            stream.close()
        what = json.loads(text) if text else {}  # lost before it could say anything, so nothing was changed
        if "copy" in what and exists(self.spark, what["copy"]):
            put(self.spark.read.parquet(what["copy"]), self.path, what["emptied"])
        self.done(number)


def put(copy: DataFrame, path: str, emptied: list[int]) -> None:
    """Have a ledger's parts be those of a copy, and these parts be empty; other parts stay.  Doing it again does no harm."""
    copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for part in emptied:
        delete(copy.sparkSession, f"{path}/part={part}")


def appended(spark: SparkSession, path: str, write: Callable[[int], dict]) -> dict:
    """What write, which gets the commit's number, reads a ledger and appends to it, returns; made anew where another writer was first."""
    commits = Commits(spark, path)
    for _ in range(ATTEMPTS):
        number = commits.ready() + 1
        try:
            commits.claim(number, {"kind": "append"})
        except Conflict:
            continue
        try:
            return write(number)
        finally:
            commits.done(number)
    raise Conflict(f"{ATTEMPTS} times another writer of {path} was first")


def rewritten(spark: SparkSession, path: str, parts: list[int], change: Callable[[DataFrame], DataFrame], ids: bool = False) -> None:
    """Have parts of a ledger be what change makes of them; no other part is read or written.

    change gets the stored rows of the parts, and gives rows of these parts.  It is called
    again with newer rows where another writer was first.  ids says that there may be new ids
    among them, which the ledger's screen, if it has one, must know.
    """
    commits = Commits(spark, path)
    for _ in range(ATTEMPTS):
        number = commits.ready() + 1
        with scope(spark):
            stored = spark.read.parquet(path)
            rows = stored.where(stored["part"].isin(parts))
            copy = settle(change(rows).select(rows.columns), "rewrite")
            left = {r.part for r in copy.select("part").distinct().collect()}
            if not left <= set(parts):
                raise ValueError("a rewrite gives rows of parts that it has not read")
            emptied = sorted(set(parts) - left)
            try:
                commits.claim(number, {"kind": "rewrite", "copy": copy.inputFiles()[0].rpartition("/")[0] if left else "", "emptied": emptied})
            except Conflict:
                continue
            screen = Screen(spark, path)
            if ids and screen.filters():
                screen.grow(copy, number, stored)
            put(copy, path, emptied)
            commits.done(number)
            return
    raise Conflict(f"{ATTEMPTS} times another writer of {path} was first")
