"""Format drift: lines that no reader knew are kept, counted, and read again once one does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.canonical import canonical_json, event_id


def unrecognized_type() -> Column:
    return F.get_json_object("content_json", "$.unrecognized_type")


def counts(events: DataFrame) -> DataFrame:
    """(type, n) of events that no reader knew, most frequent first."""
    return events.where("kind = 'unrecognized'").groupBy(unrecognized_type().alias("type")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type")


def superseded(events: DataFrame) -> DataFrame:
    """(id) of events that a supersession links to."""
    return events.where("kind = 'supersession'").select(F.explode("links").alias("l")).where("l.rel = 'supersedes'").select(F.col("l.target").alias("id")).distinct()


def renormalize(events: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(interpreted, supersessions) for unrecognized events that are not superseded yet.

    convert turns unrecognized events into event rows, with the old id as replaces;
    those it still cannot read it leaves out.  What is in the ledger already is not
    made again, so a second run makes nothing.
    """
    open_ = events.where("kind = 'unrecognized'").join(superseded(events), "id", "left_anti")
    made = convert(open_).withColumn("id", event_id())
    columns = events.columns
    links = F.array(F.struct(F.lit("supersedes").alias("rel"), F.col("replaces").alias("target")))
    content = canonical_json(F.to_json(F.struct(F.col("id").alias("by"), F.lit("renormalized").alias("reason"), F.col("replaces").alias("superseded"))))
    notes = made.withColumns({"kind": F.lit("supersession"), "links": links, "content_json": content}).withColumn("id", event_id()).select(columns)
    return made.select(columns).join(events.select("id"), "id", "left_anti").select(columns), notes
