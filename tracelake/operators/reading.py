"""Reads over event tables: filters, scope, duplicate collapse, order, positions, summaries, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.canonical import canonical_json
from tracelake.operators.graph import cut
from tracelake.shared import counted

#: Kinds that record how a session ran rather than what was said.
MACHINERY = ("session_state", "activity", "context_injection", "file_snapshot")
#: Anchors up to which a scope is sent to all tasks; each of more is dealt to SPREAD tasks.
SENT, SPREAD = 100_000, 16


def where(events: DataFrame, kind: str | None = None, source: str | None = None, model: str | None = None, conversation: str | None = None) -> DataFrame:
    """Events by exact kind, source and model, and by a prefix of the conversation id."""
    for column, value in (("kind", kind), ("producer.source", source), ("producer.model", model)):
        if value is not None:
            events = events.where(F.col(column) == value)
    return events if conversation is None else events.where(F.col("conversation.id").startswith(conversation))


def of_anchors(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows of these anchors; a few anchors may hold all rows, so no task is given an anchor's rows."""
    scope, n = counted(anchors.select("anchor").where(F.col("anchor").isNotNull()).distinct(), "anchors")
    if n <= SENT:
        return rows.join(F.broadcast(scope), "anchor", "left_semi").select(rows.columns)
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if t in ("string", "bigint", "int")]), F.lit(SPREAD)))
    scope = scope.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return dealt.join(scope, ["anchor", "_deal"], "left_semi").select(rows.columns)


def in_scope(events: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """Events whose anchor is in view, and pending ones; None as the scope keeps everything, an empty scope pending only."""
    if anchors is None:
        return events
    pending = events.where(F.col("anchor").isNull())
    return of_anchors(events, anchors).unionByName(pending)


def depth() -> Column:
    """How many spans of an event were redacted."""
    return F.coalesce(F.size("redactions"), F.lit(0))


def collapse(events: DataFrame, tie: str = "content_json") -> DataFrame:
    """One row an id: the most redacted copy, then the earliest recorded, then the smallest by tie."""
    best = Window.partitionBy("id").orderBy(F.greatest(depth(), F.lit(0)).desc(), F.col("recorded_at"), F.col(tie))
    return events.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")


def order_keys(collation: str | None = "UNICODE") -> list[Column]:
    """Conversation, sequence, time, id; events without a conversation come first."""
    text = (lambda c: F.collate(c, collation)) if collation else (lambda c: c)
    return [text(F.coalesce("conversation.id", F.lit(""))), F.coalesce("conversation.seq", F.lit(0)), text(F.col("occurred_at")), text(F.col("id"))]


def sort(events: DataFrame, collation: str | None = "UNICODE") -> DataFrame:
    return events.orderBy(*order_keys(collation))


def with_position(events: DataFrame) -> DataFrame:
    """Positions within a conversation by dense rank of seq, over all events, so filters applied later don't move them."""
    rank = F.dense_rank().over(Window.partitionBy("conversation.id").orderBy("conversation.seq"))
    inside = F.col("conversation.id").isNotNull()  # events without a conversation need no window, and would all be in one
    return events.where(inside).withColumn("position", rank).unionByName(events.where(~inside).withColumn("position", F.lit(None).cast("int")))


def displayed(kinds: tuple[str, ...] = (), with_reasoning: bool = False, with_machinery: bool = False) -> Column:
    """Hides reasoning, and machinery that no human drove, unless asked for by kind or switch."""
    shown = F.lit(True)
    if not with_reasoning and "reasoning" not in kinds:
        shown &= F.col("kind") != "reasoning"
    if not with_machinery:
        hidden = [k for k in MACHINERY if k not in kinds]
        shown &= ~F.col("kind").isin(hidden) | (F.col("actor.type") == "human")
    return shown


def role() -> Column:
    return F.coalesce(F.get_json_object("content_json", "$.role"), F.col("actor.type"))


def snippet(text: Column, width: int = 100) -> Column:
    """White space collapsed, cut to width with dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def log_line() -> Column:
    """One line for people: time, kind, role, conversation and position, beginning of the text."""
    body = snippet(F.coalesce(F.get_json_object("content_json", "$.text"), F.col("content_json")))
    where_ = F.concat(F.substring(F.coalesce("conversation.id", F.lit("-")), 1, 28), F.lit("#"), F.coalesce(F.col("position").cast("string"), F.lit("-")))
    return F.concat_ws("  ", "occurred_at", "kind", F.rpad(role(), 9, " "), where_, body)


def by_prefix(events: DataFrame, prefix: str) -> DataFrame:
    """The events whose id starts with the prefix, with or without its scheme; an ambiguous prefix is an error."""
    found = events.where(F.col("id").startswith(prefix) | F.substring("id", 5, 64).startswith(prefix))
    if found.select("id").distinct().limit(2).count() > 1:
        raise ValueError(f"more than one event starts with {prefix}")
    return found


def conversations(events: DataFrame) -> DataFrame:
    """Per conversation: turns, first and last time, the source of the first event in order, models; in no order."""
    first = F.struct(F.coalesce("conversation.seq", F.lit(0)).alias("a"), F.col("occurred_at").alias("b"), F.col("id").alias("c"))
    models = F.array_sort(F.collect_set("producer.model"))
    return events.groupBy(F.coalesce("conversation.id", F.lit("(none)")).alias("conversation")).agg(
        F.count("*").alias("events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"),
        F.min_by(F.coalesce("producer.source", "producer.tool"), first).alias("source"),
        F.when(F.size(models) > 0, F.array_join(models, ",")).otherwise("-").alias("models"),
    )


def by_last_activity(summaries: DataFrame) -> DataFrame:
    """Summaries of conversations, the one active last at the end."""
    return summaries.orderBy("last_at", "conversation")


def tree(events: DataFrame) -> DataFrame:
    """(conversation, parent, events) with the root of each, following parents level by level.

    A conversation whose parent has no events here is a root.  Those on a cycle, and
    below one, come with a null root and level.
    """
    own = events.where(F.col("conversation.id").isNotNull()).groupBy(F.col("conversation.id").alias("conversation")).agg(F.max("conversation.parent").alias("parent"), F.count("*").alias("events"))
    own = cut(own)
    held = own.select(F.col("conversation").alias("_held"))
    tops = own.join(held, F.col("parent") == F.col("_held"), "left_anti")
    rooted = tops.withColumns({"root": F.col("conversation"), "level": F.lit(0)})
    frontier, level = rooted, 0
    while True:
        level += 1
        below = own.alias("o").join(frontier.alias("f"), F.col("o.parent") == F.col("f.conversation")).select("o.*", "f.root", F.lit(level).alias("level"))
        below = cut(below)
        if below.isEmpty():
            rest = own.join(rooted.select(F.col("conversation").alias("_held")), F.col("conversation") == F.col("_held"), "left_anti")
            return rooted.unionByName(rest.withColumns({"root": F.lit(None).cast("string"), "level": F.lit(None).cast("int")}))
        rooted, frontier = rooted.unionByName(below), below


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value in force at each row: the last one stated before or at it, else the first stated after it."""
    base = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(base.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(f"{value}_in_force", F.coalesce(before, after))


def export_line(columns: list[str]) -> Column:
    """An event as one line of canonical JSON, without fields that are null."""
    parts = {c: F.from_json("content_json", "variant") if c == "content_json" else F.col(c) for c in columns}
    return canonical_json(F.to_json(F.struct(*[v.alias("content" if c == "content_json" else c) for c, v in parts.items()])))


def export(events: DataFrame, path: str) -> None:
    """Write events as text files of one line each, in no order of their own; sort first where order matters."""
    events.select(export_line(events.columns).alias("value")).write.text(path)


def head(events: DataFrame, most: int, collation: str | None = "UNICODE") -> DataFrame:
    """The first lines (value) of an export in order; no more than these are sorted out of each partition."""
    return sort(events, collation).limit(most).select(export_line(events.columns).alias("value"))


def notes(events: DataFrame) -> DataFrame:
    """(anchor, place, value): the distinct lines of each anchor, by their bytes."""
    lines = events.where(F.col("anchor").isNotNull()).select("anchor", export_line([c for c in events.columns if c not in ("anchor", "part")]).alias("value")).distinct()
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("value")) - 1).select("anchor", "place", "value")


def imported(lines: DataFrame, schema) -> DataFrame:
    """Events back from exported lines (value); a line that is no event is an error."""
    shape = ", ".join(f"{'content variant' if f.name == 'content_json' else f'`{f.name}` {f.dataType.simpleString()}'}" for f in schema)
    rows = lines.select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return rows.withColumn("content_json", canonical_json(F.to_json("content"))).select(schema.names)
