"""Lines of text files with their number and byte address, from files that Spark splits.

Spark reads a file in blocks, each by a task, and tells a row its block.  A task numbers the
lines of its blocks and adds up their bytes as they come; sums over the blocks before,
a row each, make numbers and addresses in the file.  So a file of any size is read by many
tasks, and no text is shuffled.

Lines end with a line feed; a carriage return before it belongs to the line.  A byte order
mark at a file's start belongs to none.  Of compressed files addresses count the text's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.workers import trimmed
from tracelake.shared import settle

_NUMBERED = ["file", "size", "block", "value", "nth", "at"]


def _numbered(batches):
    """Rows (file, size, block, value, bytes) with their number and the bytes before them in their block; blocks come one after another."""
    last, nth, at = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        files, blocks = b.column(0), b.column(2).to_numpy()
        files = files.dictionary_encode().indices.to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])]))
        size = b.column(4).to_numpy().astype(np.int64) + 1
        before, row = np.cumsum(size) - size, np.arange(b.num_rows)
        run = np.repeat(np.arange(len(begins)), np.diff([*begins, b.num_rows]))
        local, address = row - begins[run], before - before[begins[run]]
        if (b.column(0)[0].as_py(), int(blocks[0])) == last:  # the last block of the batch before goes on
            goes_on = run == 0
            local, address = local + nth * goes_on, address + at * goes_on
        last, nth, at = (b.column(0)[-1].as_py(), int(blocks[-1])), int(local[-1]) + 1, int(address[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(local), pa.array(address)], _NUMBERED)


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, seq, value, begin, end, size, closed) of every line, empty ones too.

    seq counts from 0; end is behind the line's line feed, if it has one; size is the
    file's; closed tells whether the file's last line is ended.  The lines are written
    to the shared folder once, so that a file which grows meanwhile does no harm.
    """
    meta = {"file": "file_path", "size": "file_size", "block": "file_block_start"}
    rows = spark.read.option("lineSep", "\n").text(list(paths)).select(*[F.col(f"_metadata.{m}").alias(n) for n, m in meta.items()], "value")
    rows = rows.withColumn("bytes", F.octet_length("value"))
    rows = settle(rows.mapInArrow(trimmed(_numbered), "file string, size long, block long, value string, nth long, at long"), "lines")
    blocks = rows.groupBy("file", "size", "block").agg(F.count("*").alias("n"), F.max(F.col("at") + F.octet_length("value") + 1).alias("bytes"))
    ahead, whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.sum("bytes").over(whole).alias("total"))
    # all lines with a line feed each are as long as the file, or longer by one where the last has none, and a mark shorter
    rest = F.col("size") - F.col("total")
    mark = F.when(rest.isin(2, 3), 3).otherwise(0)
    open_ = rest.isin(-1, 2)
    begin = F.col("bytes_before") + F.col("at") + mark
    end = begin + F.octet_length("value") + 1
    rows = rows.join(blocks, ["file", "block"])
    fits = rest.isin(-1, 0, 2, 3)
    return rows.select("file", (F.col("lines_before") + F.col("nth")).alias("seq"), "value", begin.alias("begin"), F.when(fits, F.least(end, F.col("size"))).otherwise(end).alias("end"), "size", (~open_).alias("closed"))
