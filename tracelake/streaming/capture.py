"""Incremental capture: files that grow are read on from a cursor, new files come as a stream; ids make replays harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.rules import Rule
from tracelake.operators import drift, graph, ledger
from tracelake.shared import scope
from tracelake.sources import tables, transcripts

CURSORS = T.StructType([T.StructField("file", T.StringType()), T.StructField("count", T.LongType()), T.StructField("size", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("round", T.LongType())])
Reader = Callable[[DataFrame], DataFrame]


def events_of(drafts: DataFrame, anchor: str | None = None, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None) -> DataFrame:
    """Finalised events with the lines they were made from, both redacted, without the columns that only readers use."""
    return tables.finalize(drafts, rules, exact).drop("file", "line").withColumn("anchor", F.lit(anchor).cast("string"))


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """The last cursor of each file: rounds are appended, so a failed round leaves the ones before it whole."""
    rows = ledger.table(spark, path, CURSORS)
    if rows is None:
        return spark.createDataFrame([], CURSORS)
    return rows.groupBy("file").agg(F.max_by(F.struct("count", "size", "digest"), "round").alias("c"), F.max("round").alias("round")).select("file", "c.*", "round")


def catch_up(lines: DataFrame, reader: Reader, ledger_path: str, cursor_path: str, anchor: str | None = None, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Read lines (file, seq, value, closed) on from the cursors, append what they say, then move the cursors.

    A torn last line is held back until its file has grown.  The ledger is written
    before the cursors, so a round that fails between them is read again, and adds
    nothing the second time.  reader sees the whole of each file that has new lines, or
    whose lines changed, as a line's meaning may depend on lines before it.  Of drafts
    made from one line those of new lines count; drafts that may hang on any line of
    their file, as those of logs and exports, are all sent, and the append leaves out
    what the ledger holds.  So a message that waits for a call to end comes once the log
    says so, however far the cursor is.  Texts are redacted (see ledger.append).
    """
    spark = lines.sparkSession
    with scope(spark):
        lines = graph.cut(lines)  # read once, and parsed once for what is new
        seen = cursors(spark, cursor_path)
        states = ledger.parsed(lines)
        done = graph.cut(states.where("state <> 'torn'").select("file", "seq", F.xxhash64("seq", "value").alias("digest")))
        marks = done.groupBy("file").agg(F.bit_xor("digest").alias("digest"), F.max("seq").alias("_top"))
        changed = marks.join(seen.select("file", "count", F.col("digest").alias("_old")), "file").where(~F.col("digest").eqNullSafe(F.col("_old")) & (F.col("_top") < F.col("count"))).select("file")
        open_ = ledger.resume(done, seen).select("file", "seq").unionByName(done.join(changed, "file", "left_semi").select("file", "seq")).distinct()
        open_ = graph.cut(open_)
        touched = open_.select("file").distinct()
        drafts = reader(lines.join(touched, "file", "left_semi").select("file", "seq", "value", "closed"))
        own = drafts.where("line is not null")
        fresh = own.join(open_.select("file", F.col("seq").alias("line")), ["file", "line"], "left_semi").select(drafts.columns).unionByName(drafts.where("line is null"))
        counts = ledger.append(events_of(fresh, anchor, rules, exact), ledger_path, rules=[])
        sizes = states.groupBy("file").agg(consumed(lines).alias("size"))
        turn = (seen.agg(F.max("round")).first()[0] or 0) + 1
        moved = ledger.cursors(states).select("file", F.col("count").cast("long").alias("count")).join(sizes, "file").join(marks.drop("_top"), "file", "left").withColumn("round", F.lit(turn).cast("long"))
        moved.join(touched, "file", "left_semi").select(CURSORS.names).write.mode("append").parquet(cursor_path)
    return counts


def consumed(lines: DataFrame) -> Column:
    """How many bytes of a file its lines' states say are done: all of it, or up to a torn line."""
    if "size" in lines.columns:
        return F.coalesce(F.min(F.when(F.col("state") == "torn", F.col("begin"))), F.max("size")).cast("long")
    return F.sum(F.when(F.col("state") == "torn", 0).otherwise(F.octet_length("value") + 1)).cast("long")


QUARANTINE = T.StructType([T.StructField("file", T.StringType()), T.StructField("size", T.LongType()), T.StructField("error", T.StringType())])


def sweep(
    spark: SparkSession, folder: str, reader: Reader, ledger_path: str, cursor_path: str, quarantine_path: str, adopt: bool = False, read=transcripts.lines, most_files: int = 10_000, **settings
) -> DataFrame:
    """Capture what files below a folder have grown by since their cursors; (file, size, state, error) of those looked into.

    Files are told by a listing alone: one that is no longer than its cursor says is not opened,
    and one without a cursor is left to the capture that it belongs to, unless adopt is set.
    Up to most_files at a time are caught up together (settings go to catch_up).  If that fails,
    halves are tried, until the file that fails is alone: it goes to the quarantine table with its
    error, and stops nothing.  A file in quarantine is tried again once its size has changed.
    """
    seen, listed = cursors(spark, cursor_path), transcripts.files(spark, folder).select("file", "size")
    with scope(spark):
        grown = ledger.stale(listed, seen)
        if adopt:
            grown = grown.unionByName(listed.join(seen.select("file"), "file", "left_anti"))
        held = ledger.table(spark, quarantine_path, QUARANTINE)
        if held is not None:
            grown = grown.join(held.select("file", "size").distinct(), ["file", "size"], "left_anti")
        grown = graph.cut(grown)
        rows, part = [], []
        for row in grown.orderBy("file").toLocalIterator():  # names, as many as Spark lists on the driver to read them
            part.append(row)
            if len(part) == most_files:
                rows += _caught_up(spark, part, read, reader, ledger_path, cursor_path, settings)
                part = []
        rows += _caught_up(spark, part, read, reader, ledger_path, cursor_path, settings)
    found = spark.createDataFrame(rows, "file string, size long, state string, error string")
    bad = [r for r in rows if r[2] == "quarantined"]
    if bad:
        spark.createDataFrame([(f, n, e) for f, n, _, e in bad], QUARANTINE).write.mode("append").parquet(quarantine_path)
    return found


def _caught_up(spark: SparkSession, part: list, read, reader: Reader, ledger_path: str, cursor_path: str, settings: dict) -> list[tuple]:
    """(file, size, state, error) of files (file, size) caught up together, or by halves where that fails."""
    if not part:
        return []
    try:
        with scope(spark):
            catch_up(read(spark, *[r.file for r in part]), reader, ledger_path, cursor_path, **settings)
        return [(r.file, r.size, "read", None) for r in part]
    except Exception as error:
        if len(part) == 1:
            return [(part[0].file, part[0].size, "quarantined", (str(error).strip().splitlines() or [type(error).__name__])[0][:500])]
        half = len(part) // 2
        return _caught_up(spark, part[:half], read, reader, ledger_path, cursor_path, settings) + _caught_up(spark, part[half:], read, reader, ledger_path, cursor_path, settings)


def stream(spark: SparkSession, folder: str, reader: Reader, ledger_path: str, checkpoint: str, anchor: str | None = None, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Capture all files of a folder that its checkpoint has not seen, and stop; counts of rows appended and deduped."""
    total = {"appended": 0, "deduped": 0}

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.select("file", F.col("value").endswith("\n").alias("closed"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
        rows = rows.where(F.trim("value") != "").select("file", F.col("seq").cast("long").alias("seq"), "value", "closed")
        with scope(spark):
            counts = ledger.append(events_of(reader(rows), anchor, rules, exact), ledger_path, rules=[])
        for k, n in counts.items():
            total[k] += n

    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return total


def unknown(ledger_events: DataFrame) -> DataFrame:
    """What a capture could not read, by type: drift to look at."""
    return drift.counts(ledger_events)


def again(reader: Reader) -> Callable[[DataFrame], DataFrame]:
    """A converter for drift.renormalize: a reader put to the lines that unrecognized events keep.

    An event's line is read as the only one of its place in a file named by its session;
    those that the reader still does not know are left out.
    """

    def convert(events: DataFrame) -> DataFrame:
        file = F.concat(F.lit("/again/"), F.col("id"), F.lit("/"), F.coalesce("producer.session_id", "conversation.id"), F.lit(".jsonl"))
        kept = events.where(F.col("raw_json").isNotNull())
        lines = kept.select(file.alias("file"), F.col("conversation.seq").alias("seq"), F.col("raw_json").alias("value"), F.lit(True).alias("closed"))
        made = tables.finalize(reader(lines).where("kind <> 'unrecognized'"))
        old = kept.select(file.alias("file"), F.col("id").alias("replaces"), F.col("anchor").alias("_anchor"), F.struct("conversation.id", "conversation.seq", "conversation.parent").alias("_place"), F.col("occurred_at").alias("_at"))
        made = made.join(old, "file").withColumns({"anchor": F.col("_anchor"), "conversation": F.col("_place").cast(events.schema["conversation"].dataType), "occurred_at": F.coalesce("_at", "occurred_at")})
        return made.select("replaces", *events.columns)

    return convert
