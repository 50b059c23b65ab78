"""Tables and values that a job makes on its way: written below the cluster's shared folder, and taken back when done."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of the cluster, spark.checkpoint.dir.

    Where that is unset and all of Spark is one process on this machine, as in tests, a
    temporary folder is made, becomes the setting of the session, and goes when Python
    ends.  On a cluster that is an error: executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tracelake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scope:
    """What a job has written and broadcast on its way, oldest first."""

    def __init__(self):
        self.folders: list[str] = []
        self.broadcasts: list = []


#: The scope that a job is in; without one of its own, that of the process, which clear() empties.
_scope: ContextVar[Scope] = ContextVar("scope", default=Scope())
_folder_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


@contextmanager
def scope(spark: SparkSession):
    """A job whose results are written, or collected, before it ends: what it settles and shares in between is taken back then.

    Scopes of other jobs, also in other threads, and what lies around this one stay as they are.
    """
    held = _scope.set(Scope())
    try:
        yield
    finally:
        mine = _scope.get()
        _scope.reset(held)
        for path in mine.folders:
            delete(spark, path)
        for made in mine.broadcasts:
            made.destroy()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _scope.get().folders.append(path)
    _folder_of[out] = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A settled table and how many rows it has, counted as they are written."""
    seen = Observation()
    out = settle(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def share(spark: SparkSession, value):
    """A broadcast of a value of bounded size; the scope, or clear(), destroys it."""
    made = spark.sparkContext.broadcast(value)
    _scope.get().broadcasts.append(made)
    return made


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = place(spark, path)
    return files.exists(where)


def bytes_of(spark: SparkSession, path: str) -> int:
    """The bytes of a folder's files, by listing it; 0 where there is none."""
    files, where = place(spark, path)
    return int(files.getContentSummary(where).getLength()) if files.exists(where) else 0


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, where = place(spark, path)
    files.delete(where, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a short text to a file."""
    files, where = place(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def named_files(lines: DataFrame, folder: str) -> None:
    """Write lines (name, place, value) as a text file for each name below a folder, in the order of place; files of these names give way.

    Executors write, a task all of some names; the driver renames, so names should be few.
    """
    spark, by = lines.sparkSession, lines.repartition("name").sortWithinPartitions("name", "place")
    work = shared_dir(spark, "files")
    by.select("name", "value").write.partitionBy("name").text(work)
    files, where = place(spark, work)
    root = place(spark, folder)[1]
    files.mkdirs(root)
    for part in [x.getPath() for x in files.listStatus(where) if x.isDirectory()]:
        (made,) = [x.getPath() for x in files.listStatus(part) if x.getPath().getName().startswith("part-")]
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, part.getName().removeprefix("name="))
        files.delete(to, False)
        files.rename(made, to)
    files.delete(where, True)


def foldered_files(rows: DataFrame, folder: str) -> None:
    """Write rows (name, value) as a text file for each name, in a folder name=... of its own below a folder.

    For many names: tasks write and move their files themselves, none is named or moved by the driver.
    The work goes by files, not bytes, so tasks are not merged for being small.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows.select("name", "value").repartition(tasks, "name").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(folder)


def drop(df: DataFrame) -> None:
    """Delete the folder of a settled table that nothing will read again."""
    path, mine = _folder_of.pop(df, None), _scope.get()
    if path in mine.folders:
        mine.folders.remove(path)
        delete(df.sparkSession, path)


def mark() -> tuple[set[str], int]:
    """What there is to clear now, for clear()."""
    mine = _scope.get()
    return set(mine.folders), len(mine.broadcasts)


def clear(spark: SparkSession, since: tuple[set[str], int] = (frozenset(), 0), keep: DataFrame | None = None) -> None:
    """Delete what this scope settled and shared since a mark, but for one table; for when the results are written."""
    mine, held = _scope.get(), _folder_of.get(keep) if keep is not None else None
    for path in [x for x in mine.folders if x not in since[0] and x != held]:
        mine.folders.remove(path)
        delete(spark, path)
    for made in mine.broadcasts[since[1] :]:
        made.destroy()
    del mine.broadcasts[since[1] :]
