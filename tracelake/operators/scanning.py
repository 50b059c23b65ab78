"""Secret scans: findings with coordinates, grouping by fingerprint, allow lists, context."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tracelake.functions.rules import Rule, find, print_of, rules_for
from tracelake.functions.workers import trimmed

#: The columns of an event that hold JSON, and the path that their leaves start with.
JSON_PARTS = (("content_json", "content"), ("raw_json", "raw/data"))


def string_leaves(value, path: str):
    """(path, text) of each string in a parsed JSON value, depth first; keys are not visited."""
    if isinstance(value, str):
        yield {"path": path, "value": value}
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from string_leaves(x, f"{path}/{i}")
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from string_leaves(x, f"{path}/{k}")


def _leaves(content: pd.Series) -> pd.Series:
    return content.map(lambda t: None if t is None else list(string_leaves(json.loads(t), "content")))


def leaves(content: Column | str) -> Column:
    """The string leaves of a column of JSON texts, under the path content."""
    return pandas_udf(_leaves, "array<struct<path:string,value:string>>")(content)


def exempt(kind: str | None, path: str) -> bool:
    """Sealed reasoning is opaque, so no rule applies to it."""
    return kind == "reasoning" and path.endswith("/encrypted_content")


_HIT = "rule string, fingerprint string, start int, end int"


def _with_hits(b: pa.RecordBatch, keep: list[int], hits: list[tuple], more: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """The kept columns of a batch's rows, one row a hit (row, values of more, rule, start, end, match)."""
    rows = pa.array([h[0] for h in hits], pa.int64())
    cols = [b.column(i).take(rows) for i in keep] + [pa.array([h[1 + j] for h in hits], t) for j, (_, t) in enumerate(more)]
    n = 1 + len(more)
    cols += [pa.array([h[n] for h in hits], pa.string()), pa.array([print_of(h[n + 3]) for h in hits], pa.string())]
    cols += [pa.array([h[n + k] for h in hits], pa.int32()) for k in (1, 2)]
    return pa.RecordBatch.from_arrays(cols, [*(b.schema.names[i] for i in keep), *(name for name, _ in more), "rule", "fingerprint", "start", "end"])


def scan(texts: DataFrame, text: str, tier: str = "standard", rules: list[Rule] | None = None) -> DataFrame:
    """One row a finding: the columns of texts without the text, then rule, fingerprint, start, end.

    Each rule reads the text as it is, so a span may be found by several rules.
    Offsets are code points.  One pass over batches with compiled patterns.
    """
    rules = rules_for(tier) if rules is None else rules
    at, keep = texts.columns.index(text), [i for i, c in enumerate(texts.columns) if c != text]

    def run(batches):
        for b in batches:
            yield _with_hits(b, keep, [(i, *hit) for i, t in enumerate(b.column(at).to_pylist()) if t for hit in find(t, rules)], [])

    schema = T.StructType([*(texts.schema[i] for i in keep), *T.StructType.fromDDL(_HIT).fields])
    return texts.mapInArrow(trimmed(run), schema)


def scan_events(events: DataFrame, tier: str = "standard", rules: list[Rule] | None = None) -> DataFrame:
    """Findings in all strings of events' contents, and of their raw lines where there are: event_id, conversation, occurred_at, path, rule, fingerprint, start, end."""
    rules = rules_for(tier) if rules is None else rules
    parts = [(c, path) for c, path in JSON_PARTS if c in events.columns]
    rows = events.select(F.col("id").alias("event_id"), F.col("conversation.id").alias("conversation"), "occurred_at", "kind", *[c for c, _ in parts])

    def hits(i, kind, texts):
        for (_, path), t in zip(parts, texts):
            for leaf in [] if t is None else string_leaves(json.loads(t), path):
                if not exempt(kind, leaf["path"]):
                    for hit in find(leaf["value"], rules):
                        yield i, leaf["path"], *hit

    def run(batches):
        for b in batches:
            kinds, texts = b.column(3).to_pylist(), zip(*(b.column(4 + j).to_pylist() for j in range(len(parts))))
            yield _with_hits(b, [0, 1, 2], [h for i, (kind, t) in enumerate(zip(kinds, texts)) for h in hits(i, kind, t)], [("path", pa.string())])

    return rows.mapInArrow(trimmed(run), "event_id string, conversation string, occurred_at string, path string, " + _HIT)


def _first_events(findings: DataFrame, event: Column, most: int = 3) -> DataFrame:
    """(fingerprint, shown): the smallest event ids of each fingerprint, ranked so that a common one brings few rows to its task."""
    one = findings.select("fingerprint", event.alias("_event")).distinct()
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("_event"))
    return one.withColumn("_n", rank).where(F.col("_n") <= most).groupBy("fingerprint").agg(F.array_sort(F.collect_list("_event")).alias("shown"))


def grouped(findings: DataFrame, event: str = "event_id") -> DataFrame:
    """Per fingerprint: the first rule, sites, distinct events, up to three of their ids in order."""
    order = F.struct(event, "start", "rule")
    rows = findings.groupBy("fingerprint").agg(F.min_by("rule", order).alias("rule"), F.count("*").alias("sites"), F.count_distinct(event).alias("events"))
    shown = F.array_join(F.col("shown").cast("array<string>"), ",")
    return rows.join(_first_events(findings, F.col(event)), "fingerprint").select("fingerprint", "rule", "sites", "events", shown.alias("first_events"))


def allowlist(*lists: DataFrame) -> DataFrame:
    """The union of allow lists of fingerprints."""
    return reduce(DataFrame.union, [x.select("fingerprint") for x in lists]).distinct()


def outstanding(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings whose fingerprint is on no allow list."""
    return findings.join(allowed, "fingerprint", "left_anti")


def context(text: Column, start: Column, end: Column, around: int = 400, mark: str = "<redacted>") -> Column:
    """The text around a span, with the span itself covered by a mark."""
    begin = F.greatest(start - around, F.lit(0))
    return F.concat(F.substring(text, begin + 1, start - begin), F.lit(mark), F.substring(text, end + 1, F.lit(around)))


def finding_line() -> Column:
    """A finding as a line for people: where it is and what it is called, never what it says."""
    place = F.concat("path", F.lit("@"), "start")
    return F.concat_ws("  ", F.substring("event_id", 1, 16), F.coalesce("conversation", F.lit("-")), "occurred_at", "rule", place, F.concat(F.lit("["), "fingerprint", F.lit("]")))


def report(findings: DataFrame) -> DataFrame:
    """(fingerprint, sites, text): a paragraph for each group of findings, with its first site and up to three events."""
    order = F.struct("occurred_at", "event_id", "path", "start", "rule")
    first = F.min(F.struct(order.alias("o"), finding_line().alias("line")))
    rows = findings.groupBy("fingerprint").agg(first.alias("first"), F.count("*").alias("sites"), F.count_distinct("event_id").alias("events"))
    rows = rows.join(_first_events(findings, F.substring("event_id", 1, 16)), "fingerprint")
    more = F.when(F.col("events") > 3, F.format_string(" and %d more", F.col("events") - 3)).otherwise("")
    text = F.format_string("[%s] %s: %d sites in %d events\n  first %s\n  events %s%s", "fingerprint", F.col("first.o.rule"), "sites", "events", F.col("first.line"), F.array_join("shown", ", "), more)
    return rows.select("fingerprint", "sites", text.alias("text"))
