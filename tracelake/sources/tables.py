"""Events from generic tables: chat turns, application activity, documents and labels.

An event row has id, schema, kind, occurred_at, recorded_at (ISO-8601 strings),
actor, producer, media_type, content_json (canonical), conversation, links, anchor
(the commit whose note holds it, null while pending) and redactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.canonical import SCHEMA, event_id
from tracelake.functions.rules import Rule
from tracelake.operators import redaction

BASE = "2026-01-01 00:00:00"
ACTORS = {"user": "human", "assistant": "agent", "system": "system"}
_LINKS = "array<struct<rel:string,target:string>>"
_REDACTIONS = "array<struct<rule:string,ruleset:string,fingerprint:string,path:string>>"


def iso(at: Column) -> Column:
    """A timestamp without zone, taken as UTC, as ISO-8601 text with milliseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def after_base(seconds: str) -> Column:
    """The base time and so many seconds more, as a timestamp without zone, so no session's zone shifts it."""
    return F.expr(f"timestamp_ntz '{BASE}' + make_dt_interval(0, 0, 0, cast({seconds} as decimal(18, 6)))")


def draft(rows: DataFrame, *, kind: Column, occurred_at: Column, actor: Column, source: str, content: Column, conversation: Column | None = None, seq: Column | None = None, parent: Column | None = None, model: Column | None = None, session: Column | None = None, version: Column | None = None, provider: Column | None = None, links: Column | None = None, anchor: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events from rows of any shape; content is a struct, array or JSON text."""
    none = F.lit(None).cast("string")
    or_none = lambda x: none if x is None else x.cast("string")
    return rows.select(
        F.lit(SCHEMA).alias("schema"),
        kind.alias("kind"),
        occurred_at.alias("occurred_at"),
        occurred_at.alias("recorded_at"),
        F.struct(actor.alias("type"), none.alias("id")).alias("actor"),
        F.struct(F.lit("tracelake").alias("tool"), F.lit(source).alias("source"), or_none(model).alias("model"), or_none(session).alias("session_id"), or_none(version).alias("source_version"), or_none(provider).alias("provider")).alias("producer"),
        none.alias("media_type"),
        content.alias("content_json"),
        F.struct(or_none(conversation).alias("id"), (F.lit(None) if seq is None else seq).cast("long").alias("seq"), or_none(parent).alias("parent")).alias("conversation"),
        (F.lit(None) if links is None else links).cast(_LINKS).alias("links"),
        or_none(anchor).alias("anchor"),
        F.lit(None).cast(_REDACTIONS).alias("redactions"),
        *keep,
    )


def finalize(drafts: DataFrame, rules: list[Rule] | None = (), exact: dict[str, list[str]] | None = None) -> DataFrame:
    """Events with canonical content and their ids; content that is no JSON becomes null and shows in problems().

    Strings are redacted first by the rules (None: capture's) and exact values, if there are any.
    """
    return redaction.canonical_events(drafts, rules, exact).select(event_id().alias("id"), "*")


def problems() -> Column:
    """What is wrong with an event, as an array of short texts; empty if nothing is."""
    c = F.col
    sound = F.coalesce(c("occurred_at").try_cast("timestamp").isNotNull(), F.lit(False))
    checks = [
        (F.coalesce(c("id"), F.lit("")).rlike("^ev1-[0-9a-f]{64}$"), "id"),
        (F.length("schema") > 0, "schema"),
        (F.length("kind") > 0, "kind"),
        (sound, "occurred_at"),
        (F.length("actor.type") > 0, "actor"),
        (F.length("producer.tool") > 0, "producer"),
        (c("content_json").isNotNull(), "content"),
        (c("conversation.id").isNull() | c("conversation.seq").isNotNull(), "conversation"),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def chat(conversations: DataFrame) -> DataFrame:
    """One conversation_turn a row of (conv_id, turn, role, text); assistants carry one of three models."""
    at = after_base("conv_id * 3600 + turn * 60")
    actor = F.create_map(*[F.lit(x) for pair in ACTORS.items() for x in pair])[F.col("role")]
    model = F.when(F.col("role") == "assistant", F.concat(F.lit("model-"), F.col("conv_id") % 3))
    return draft(
        conversations, kind=F.lit("conversation_turn"), occurred_at=iso(at), actor=F.coalesce(actor, F.lit("system")), source="chat",
        content=F.to_json(F.struct("role", "text")), conversation=F.concat(F.lit("chat:"), F.col("conv_id")), seq=F.col("turn"), model=model,
    )


def activity(events: DataFrame) -> DataFrame:
    """One activity a row of (event_id, ts, user_id, event_type, value, props); seq is the rank in time within the user.

    Rows without a user are no conversation: they have neither id nor seq.
    """
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    known = F.col("user_id").isNotNull()
    rows = events.where(known).withColumn("seq", seq).unionByName(events.where(~known).withColumn("seq", F.lit(None).cast("int")))
    k = F.get_json_object("props", "$.k").cast("long")
    content = F.to_json(F.struct(F.col("event_type").alias("activity_type"), k.alias("k"), F.col("value")))
    return draft(rows, kind=F.lit("activity"), occurred_at=iso(F.col("ts")), actor=F.lit("system"), source="app", content=content, conversation=F.concat(F.lit("app:"), F.col("user_id")), seq=F.col("seq"), keep=("event_id",))


def in_context(drafts: DataFrame, repo: str | None = None, branch: str | None = None, head: str | None = None, cwd: str | None = None, status: str | None = None, author: str | None = None) -> DataFrame:
    """Drafts with the place where they were captured, and human actors without an id given the author's.

    context is no part of an event's identity; of the working tree's status only a digest is kept.
    """
    text = lambda x: F.lit(x).cast("string")
    dirty = F.sha2(text(status).cast("binary"), 256) if status else text(None)
    context = F.struct(text(repo).alias("repo"), text(branch).alias("branch"), text(head).alias("head"), text(cwd).alias("cwd"), dirty.alias("dirty_fingerprint"))
    who = F.when(F.col("actor.type") == "human", F.coalesce("actor.id", text(author))).otherwise(F.col("actor.id"))
    return drafts.withColumns({"context": context, "actor": F.struct(F.col("actor.type").alias("type"), who.alias("id"))})


def document(documents: DataFrame) -> DataFrame:
    """One document event a row of (doc_id, text, lang, source)."""
    at = after_base("coalesce(doc_id, 0)")
    return draft(documents, kind=F.lit("document"), occurred_at=iso(at), actor=F.lit("system"), source="documents", content=F.to_json(F.struct("doc_id", "lang", "source", "text")), keep=("doc_id",))


def annotation(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """One annotation a label, linked to the event of its document by its id."""
    ids = finalize(document(documents)).select("doc_id", F.col("id").alias("target"), "occurred_at")
    links = F.array(F.struct(F.lit("annotates").alias("rel"), F.col("target").alias("target")))
    rows = labels.join(ids, "doc_id")
    return draft(rows, kind=F.lit("annotation"), occurred_at=F.col("occurred_at"), actor=F.lit("human"), source="labels", content=F.to_json(F.struct("quality", "toxic")), links=links, keep=("doc_id",))
