"""Readers of coding assistants' transcripts: lines of JSON, write-ahead logs and exports become event drafts.

A line's number is its place in the file, which is its sequence in the conversation.  Routing and conversion are Spark expressions
over the line's JSON; only the write-ahead log, whose records undo one another, is
folded in Python, one session at a time.

Drafts have the columns of ``tables.draft`` and raw_json (the line as it was).  A
line that is JSON of an unknown shape is kept as kind unrecognized; a line that is
no JSON is left out here, and ``ledger.parsed`` tells whether it is torn.  A line
without a time of its own takes the first one stated in its file, else base_time.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.canonical import json_object, quoted
from tracelake.operators import graph
from tracelake.operators.reading import carry_forward
from tracelake.shared import settle
from tracelake.sources import addressed, tables

OBJECT, ARRAY = "map<string,variant>", "array<variant>"
BASE_TIME = "1970-01-01T00:00:00.000Z"

# The line types of each source and what they record.
CLAUDE_STATE = ("mode", "permission-mode", "agent-setting", "agent-name", "ai-title", "last-prompt", "summary", "relocated", "worktree-state", "pr-link", "bridge-session")
CLAUDE_ACTIVITY = ("progress", "queue-operation")
CLAUDE_FILES = ("file-history-snapshot", "file-history-delta")
CLAUDE_ENVELOPE = ("type", "uuid", "parentUuid", "sessionId", "session_id", "timestamp", "cwd", "version", "gitBranch", "isSidechain", "userType", "entrypoint", "sessionKind")
CODEX_STATE, CODEX_ACTIVITY = ("session_meta", "turn_context", "world_state"), ("compacted", "inter_agent_communication_metadata")
CODEX_TWINS, CODEX_STATE_MESSAGES = ("agent_message", "user_message"), ("thread_settings_applied",)
QWEN_STATE, QWEN_INJECTION = ("custom_title", "session_source", "parent_session", "goal_state"), ("at_command", "agent_bootstrap", "agent_launch_prompt")
QWEN_FILES, QWEN_HUMAN = ("attribution_snapshot", "file_history_snapshot"), ("slash_command", "at_command")
QWEN_ENVELOPE = ("type", "subtype", "uuid", "parentUuid", "sessionId", "timestamp", "cwd", "version", "gitBranch", "provenance")
GEMINI_HARNESS, GEMINI_NOTICES = ("<session_context>", "<hook_context>"), ("info", "error", "warning")


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, seq, value, closed, begin, size) of every line that is not blank, from files of any size; see sources.addressed."""
    return addressed.lines(spark, *paths).where(F.trim("value") != "").select("file", "seq", "value", "closed", "begin", "size")


def files(spark: SparkSession, *paths: str, newest: int | None = None) -> DataFrame:
    """(file, modified, size) of files, newest first, at most so many; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    found = found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    found = found.orderBy(F.col("modified").desc(), "file")
    return found if newest is None else found.limit(newest)


def backup_digests(spark: SparkSession, folder: str, foldered: bool = False) -> DataFrame:
    """(backup_file, sha256, bytes) of the files of a backup cache; Spark passes over empty ones.

    In a foldered cache (see shared.foldered_files) a file's folder has its name.  Files are read
    once, and so many by a task as have its bytes: Spark counts 4 MB for opening each, which would
    make a task of a few.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    if foldered:
        name = F.url_decode(F.replace(F.regexp_extract("path", "/name=([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
    tuned = {"spark.sql.files.openCostInBytes": "32k", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200"}  # else folders are listed by a task each
    held = {k: spark.conf.get(k) for k in tuned}
    try:
        for k, v in tuned.items():
            spark.conf.set(k, v)
        found = spark.read.format("binaryFile").option("recursiveFileLookup", foldered).load(folder)
        return settle(found.select(name.alias("backup_file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")), "digests")
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def resolved(drafts: DataFrame, digests: DataFrame) -> DataFrame:
    """The drafts with a column resolved: of file snapshots, what a backup cache (backup_digests) holds of the versions they name.

    An array of (backup_file, sha256, bytes), each backup once, in the order in which the
    snapshot names them; null where none is there.  The drafts are written to the shared folder once.
    """
    rows = settle(drafts.withColumn("_row", F.monotonically_increasing_id()), "snapshots")
    names = F.transform(F.from_json(F.get_json_object("content_json", "$.files"), "array<struct<backup_file:string>>"), lambda x: x["backup_file"])
    named = rows.where("kind = 'file_snapshot'").select("_row", F.posexplode(F.array_distinct(F.array_compact(names))).alias("_at", "backup_file"))
    known = digests.groupBy("backup_file").agg(F.min(F.struct("sha256", "bytes")).alias("d"))
    found = named.join(known, "backup_file").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "backup_file", "d.sha256", "d.bytes"))).alias("_found"))
    kept = F.transform("_found", lambda x: F.struct(x["backup_file"].alias("backup_file"), x["sha256"].alias("sha256"), x["bytes"].alias("bytes")))
    return rows.join(found, "_row", "left").select(*drafts.columns, kept.alias("resolved"))


def project_folder(cwd: str) -> str:
    """The name under which a project's transcripts are kept: its path with slashes and dots as dashes."""
    return cwd.replace("/", "-").replace(".", "-")


def _get(path: str, value: str = "value") -> Column:
    return F.get_json_object(F.col(value), f"$.{path}")


def _is_text(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))


def without(obj: Column, *keys: str) -> Column:
    return F.map_filter(obj, lambda k, _: ~k.isin(*keys))


def put(obj: Column, fields: list[tuple[str, Column]]) -> Column:
    """A JSON object with fields (JSON texts) set; null ones are left out, and source fields of these names give way."""
    new = F.from_json(json_object(fields), OBJECT)
    return F.map_concat(F.map_filter(obj, lambda k, _: ~F.map_contains_key(new, k)), new)


def lift(obj: Column, key: str) -> Column:
    """A text field that is not blank becomes a text block."""
    x = F.try_element_at(obj, F.lit(key))
    text = F.when(_is_text(x), F.try_variant_get(x, "$", "string"))
    block = F.concat(F.lit("["), json_object([("type", F.lit('"text"')), ("text", quoted(text))]), F.lit("]"))
    return F.when(F.trim(text) != "", put(without(obj, key), [("blocks", block)])).otherwise(obj)


def blocks(content: str, convert) -> Column:
    """A JSON array of blocks from a message's content (a path): text becomes one block, array items go through convert."""
    x = F.try_variant_get(F.try_parse_json("value"), f"$.{content}", "variant")
    one = F.concat(F.lit("["), json_object([("type", F.lit('"text"')), ("text", quoted(F.try_variant_get(x, "$", "string")))]), F.lit("]"))
    many = F.concat(F.lit("["), F.array_join(F.transform(F.from_json(F.to_json(x), ARRAY), convert), ","), F.lit("]"))
    return F.when(_is_text(x), one).otherwise(F.coalesce(many, F.lit("[]")))


def _drop_signature(block: Column) -> Column:
    thinking = F.try_variant_get(block, "$.type", "string") == "thinking"
    return F.when(thinking, F.to_json(without(F.from_json(F.to_json(block), OBJECT), "signature"))).otherwise(F.to_json(block))


def _part(part: Column) -> Column:
    """A generative part as a block: call, response, thought, text, or as it is without its signature."""
    get = lambda path: F.to_json(F.try_variant_get(part, path, "variant"))
    call = json_object([("type", F.lit('"tool_use"')), ("id", get("$.functionCall.id")), ("name", get("$.functionCall.name")), ("input", get("$.functionCall.args"))])
    reply = json_object([("type", F.lit('"tool_result"')), ("tool_use_id", get("$.functionResponse.id")), ("name", get("$.functionResponse.name")), ("content", get("$.functionResponse.response"))])
    thought = F.coalesce(F.try_variant_get(part, "$.thought", "boolean"), F.lit(False))
    text = json_object([("type", F.when(thought, '"thinking"').otherwise('"text"')), ("text", get("$.text"))])
    plain = F.to_json(without(F.from_json(F.to_json(part), OBJECT), "thoughtSignature"))
    return F.when(get("$.functionCall").isNotNull(), call).when(get("$.functionResponse").isNotNull(), reply).when(_is_text(F.try_variant_get(part, "$.text", "variant")), text).otherwise(plain)


def _named_time() -> Column:
    """The time in the name of a rollout's file."""
    parts = [F.regexp_extract("file", r"rollout-(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})[^/]*$", i) for i in range(1, 5)]
    time = F.concat(parts[0], F.lit("T"), F.concat_ws(":", *parts[1:]), F.lit(".000Z"))
    return F.when((parts[0] != "") & time.try_cast("timestamp").isNotNull(), time)


def _timed(rows: DataFrame, path: str, base_time: str, named: Column | None = None) -> DataFrame:
    """occurred_at: the line's own time, else that of its file's name, else the first sound one of its file, else base_time."""
    own = _get(path)
    sound = F.when(own.try_cast("timestamp").isNotNull(), own)
    first = F.first(sound, ignorenulls=True).over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("occurred_at", F.coalesce(sound, *([] if named is None else [named]), first, F.lit(base_time)))


def _stem() -> Column:
    return F.regexp_extract("file", r"([^/]+?)(?:\.jsonl?)?$", 1)


def _or_none(rows: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in rows.columns else None


def _drafts(rows: DataFrame, source: str, content: Column, human: str | None, parent: Column | None = None, by_line: bool = True) -> DataFrame:
    """Drafts from rows with kind, who, actor_id, session, conversation, model and what content_json is made from.

    line is the line that a draft was made from; null where a draft may hang on any line of its file.
    """
    rows = rows.withColumns({"content_json": content, "line": F.col("seq") if by_line else F.lit(None).cast("long")})
    made = tables.draft(
        rows, kind=F.col("kind"), occurred_at=F.col("occurred_at"), actor=F.col("who"), source=source, content=F.col("content_json"),
        conversation=F.col("conversation"), seq=F.col("seq"), parent=parent, model=F.col("model"), session=F.col("session"), version=_or_none(rows, "version"), provider=_or_none(rows, "provider"), keep=("value", "actor_id", "file", "line", *(["raw"] if "raw" in rows.columns else [])),
    )
    who = F.when(F.col("actor.type") == "human", F.coalesce("actor_id", F.lit(human))).otherwise(F.col("actor_id"))
    return made.withColumns({"actor": F.struct(F.col("actor.type").alias("type"), who.alias("id")), "raw_json": F.col("value")}).drop("value", "actor_id")


def claude(rows: DataFrame, human: str | None = None, base_time: str = BASE_TIME) -> DataFrame:
    """Drafts from transcripts of one JSON object a line with a type; sidechain lines make sub-conversations."""
    rows = _timed(rows.where(F.try_parse_json("value").isNotNull()), "timestamp", base_time)
    kind, side = _get("type"), F.coalesce(_get("isSidechain") == "true", F.lit(False))
    obj = without(F.from_json("value", OBJECT), *CLAUDE_ENVELOPE)
    said = F.try_variant_get(F.try_parse_json("value"), "$.content", "variant")
    turn = kind.isin("user", "assistant") & _get("message").isNotNull() & _get("timestamp").isNotNull()
    spoken = (kind == "system") & _is_text(said) & (F.trim(_get("content")) != "")
    above = F.nullif(F.regexp_extract("file", r"/([^/]+)/subagents/[^/]+$", 1), F.lit(""))  # a sub-agent's file lies below its session
    session = F.coalesce(_get("sessionId"), above, _stem())
    root = F.concat(F.lit("claude-code:"), session)
    side |= above.isNotNull()
    rows = rows.withColumns({
        "kind": F.when(turn | spoken, "conversation_turn").when(kind == "system", "activity").when(kind == "attachment", "context_injection").when(kind.isin(*CLAUDE_STATE), "session_state").when(kind.isin(*CLAUDE_ACTIVITY), "activity").when(kind.isin(*CLAUDE_FILES), "file_snapshot").otherwise("unrecognized"),
        "who": F.when(turn & (kind == "assistant"), "agent").when(turn & ~side, "human").otherwise("system"),
        "actor_id": F.when(turn & (kind == "assistant"), F.nullif(_get("message.model"), F.lit(""))),
        "model": F.nullif(_get("message.model"), F.lit("")),
        "version": F.nullif(_get("version"), F.lit("")),
        "session": session,
        "conversation": F.when(side, F.concat(root, F.lit("#agent:"), F.coalesce(_get("agentId"), F.nullif(F.regexp_extract("file", r"/subagents/agent-([^/]+?)\.jsonl$", 1), F.lit("")), F.lit("unknown")))).otherwise(root),
    })
    message = json_object([("role", quoted(_get("message.role"))), ("agent", quoted(F.nullif(_get("attributionAgent"), F.lit("")))), ("blocks", blocks("message.content", _drop_signature))])
    label = lambda head, path: quoted(F.concat(F.lit(head), F.coalesce(_get(path), F.lit("untyped"))))
    saved = F.from_json(_get("snapshot.trackedFileBackups"), "map<string,variant>")
    of = lambda path, x: F.to_json(F.try_variant_get(x, path, "variant"))
    entry = lambda name, x: json_object([("path", name), ("backup_file", of("$.backupFileName", x)), ("version", of("$.version", x)), ("backup_time", of("$.backupTime", x)), ("dir", of("$.realParentDir", x))])
    every = F.transform(F.map_entries(saved), lambda e: entry(quoted(e["key"]), e["value"]))
    delta = entry(quoted(_get("trackingPath")), F.try_variant_get(F.try_parse_json("value"), "$.backup", "variant"))
    files = F.concat(F.lit("["), F.array_join(F.when(kind == CLAUDE_FILES[1], F.array(delta)).otherwise(F.coalesce(every, F.array().cast("array<string>"))), ","), F.lit("]"))
    snapshot = json_object([("operation", F.when(kind == CLAUDE_FILES[1], '"delta"').otherwise('"snapshot"')), ("message_id", quoted(_get("messageId"))), ("snapshot_message_id", quoted(_get("snapshotMessageId"))), ("is_update", _get("isSnapshotUpdate")), ("files", files)])
    content = (
        F.when(turn, message)
        .when(spoken, F.to_json(put(lift(obj, "content"), [("role", F.lit('"system"'))])))
        .when(kind == "system", F.to_json(put(obj, [("activity_type", label("system/", "subtype"))])))
        .when(kind == "attachment", F.to_json(put(obj, [("injection_type", label("attachment/", "attachment.type"))])))
        .when(kind.isin(*CLAUDE_STATE), F.to_json(put(obj, [("state_type", quoted(kind))])))
        .when(kind.isin(*CLAUDE_ACTIVITY), F.to_json(put(lift(obj, "content"), [("activity_type", quoted(kind))])))
        .when(kind.isin(*CLAUDE_FILES), snapshot)
        .otherwise(json_object([("unrecognized_type", quoted(F.coalesce(kind, F.lit("(untyped)"))))]))
    )
    return _drafts(rows, "claude-code", content, human, F.when(F.col("conversation") != root, root))


def codex(rows: DataFrame, human: str | None = None, base_time: str = BASE_TIME) -> DataFrame:
    """Drafts from rollouts of (type, timestamp, payload) a line.

    The model in force at a line is the last one stated before it in its file, else
    the first stated after.  A reasoning item makes a turn of its summary and an
    opaque event; so does a message between agents with sealed blocks, whose turn keeps
    a mark where they were, while the opaque event has them alone.  Lines that repeat a
    response item are left out.
    """
    rows = _timed(rows.where(F.try_parse_json("value").isNotNull()), "timestamp", base_time, _named_time())
    kind, sub = _get("type"), F.coalesce(_get("payload.type"), F.lit("(untyped)"))
    first = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = lambda *paths: F.first(F.when(kind == "session_meta", F.coalesce(*map(_get, paths))), ignorenulls=True).over(first)
    # few lines can state a context: the others are not parsed for it
    likely = F.col("value").contains('"session_meta"') | F.col("value").contains('"turn_context"')
    states = lambda path, *types: F.when(likely, F.when(kind.isin(*types), F.nullif(_get(path), F.lit(""))))
    rows = rows.withColumns({
        "stated": states("payload.model", "session_meta", "turn_context"),
        "version": states("payload.cli_version", "session_meta"),
        "provider": states("payload.model_provider", "session_meta"),
        "session": F.coalesce(head("payload.id", "payload.session_id"), F.nullif(F.regexp_extract("file", r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1), F.lit("")), _stem()),
        "above": F.first(F.when((kind == "session_meta") & _get("payload.source.subagent").isNotNull(), _get("payload.parent_thread_id")), ignorenulls=True).over(first),
    })
    for fact, name in (("stated", "model"), ("version", "version"), ("provider", "provider")):
        rows = carry_forward(rows, ["file"], ["seq"], fact)
        rows = rows.withColumn(name, F.col(f"{fact}_in_force")).drop(f"{fact}_in_force")
    item, reason = kind == "response_item", (kind == "response_item") & (sub == "reasoning")
    call, output = item & sub.isin("function_call", "custom_tool_call"), item & sub.isin("function_call_output", "custom_tool_call_output")
    message, mail = item & (sub == "message"), item & (sub == "agent_message")
    note = kind == "event_msg"
    rows = rows.where(~(note & sub.isin(*CODEX_TWINS)))
    summary = F.array_join(F.transform(F.from_json(_get("payload.summary"), ARRAY), lambda x: F.try_variant_get(x, "$.text", "string")), "\n")
    closed = lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == "encrypted_content", F.lit(False))
    parts = F.from_json(_get("payload.content"), ARRAY)
    mixed = mail & F.coalesce(F.exists(parts, closed), F.lit(False))
    halves = F.when(reason, F.when(F.trim(summary) != "", F.array(F.lit("summary"), F.lit("sealed"))).otherwise(F.array(F.lit("sealed"))))
    halves = halves.when(mixed, F.array(F.lit("whole"), F.lit("sealed"))).otherwise(F.array(F.lit("whole")))
    rows = rows.withColumn("half", F.explode(halves))
    sealed, said = F.col("half") == "sealed", F.col("half") == "summary"
    turn = ~sealed & (message | mail | call | output | said)
    role = F.coalesce(_get("payload.role"), F.lit("user"))
    rows = rows.withColumns({
        "kind": F.when(sealed, "reasoning").when(turn, "conversation_turn").when(kind.isin(*CODEX_STATE) | (note & sub.isin(*CODEX_STATE_MESSAGES)), "session_state").when(kind.isin(*CODEX_ACTIVITY) | note, "activity").otherwise("unrecognized"),
        "who": F.when(sealed | said | call | mail | (message & (role == "assistant")), "agent").when(message, "human").when(note & (sub.startswith("task_") | sub.startswith("sub_agent")), "agent").otherwise("system"),
        "actor_id": F.when(mail, _get("payload.author")),
        "conversation": F.concat(F.lit("codex:"), F.col("session")),
    })
    obj = F.coalesce(without(F.from_json(_get("payload"), OBJECT), "type"), F.from_json(F.lit("{}"), OBJECT))
    text = lambda x: F.try_variant_get(x, "$.type", "string").isin("input_text", "output_text", "text")
    visible = lambda x: F.when(text(x), json_object([("type", F.lit('"text"')), ("text", F.to_json(F.try_variant_get(x, "$.text", "variant")))])).otherwise(F.to_json(x))
    open_ = F.filter(parts, lambda x: ~closed(x))
    mailed = F.concat(F.lit("["), F.array_join(F.transform(open_, visible), ","), F.lit("]"))
    raw = lambda path: F.to_json(F.try_variant_get(F.try_parse_json("value"), f"$.{path}", "variant"))
    use = json_object([("type", F.lit('"tool_use"')), ("name", raw("payload.name")), ("input", F.coalesce(raw("payload.arguments"), raw("payload.input"))), ("id", raw("payload.call_id"))])
    result = json_object([("type", F.lit('"tool_result"')), ("tool_use_id", raw("payload.call_id")), ("content", raw("payload.output"))])
    one = lambda role_, block: json_object([("role", F.lit(f'"{role_}"')), ("blocks", F.concat(F.lit("["), block, F.lit("]")))])
    content = (
        F.when(sealed, json_object([("opaque", F.lit("true"))]))
        .when(said, one("reasoning_summary", json_object([("type", F.lit('"text"')), ("text", quoted(summary))])))
        .when(message, json_object([("role", quoted(role)), ("blocks", blocks("payload.content", visible))]))
        .when(mail, json_object([("role", F.lit('"agent_message"')), ("author", quoted(_get("payload.author"))), ("recipient", quoted(_get("payload.recipient"))), ("blocks", F.coalesce(mailed, F.lit("[]")))]))
        .when(call, one("assistant", use))
        .when(output, one("tool_result", result))
        .when(kind.isin(*CODEX_STATE), F.to_json(put(obj, [("state_type", quoted(kind))])))
        .when(kind.isin(*CODEX_ACTIVITY), F.to_json(put(obj, [("activity_type", quoted(kind))])))
        .when(note & sub.isin(*CODEX_STATE_MESSAGES), F.to_json(put(obj, [("state_type", quoted(F.concat(F.lit("event_msg/"), sub)))])))
        .when(note, F.to_json(put(lift(obj, "message"), [("activity_type", quoted(F.concat(F.lit("event_msg/"), sub)))])))
        .otherwise(json_object([("unrecognized_type", quoted(F.when(item, F.concat(F.lit("response_item/"), sub)).otherwise(F.coalesce(kind, F.lit("(untyped)")))))]))
    )
    parent = F.when(F.col("above").isNotNull() & (F.col("above") != F.col("session")), F.concat(F.lit("codex:"), "above"))
    # what is kept of the line: of a split message each half its own blocks, of a summary nothing, as its sealed half has the line
    listed = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))
    seen, hidden = listed(F.transform(parts, lambda x: F.when(closed(x), F.lit('{"type":"encrypted_content"}')).otherwise(F.to_json(x)))), listed(F.transform(F.filter(parts, closed), lambda x: F.to_json(x)))
    payload = F.to_json(put(F.from_json(_get("payload"), OBJECT), [("content", F.when(sealed, hidden).otherwise(seen))]))
    kept = F.when(said, F.lit(None).cast("string")).when(mixed, F.to_json(put(F.from_json("value", OBJECT), [("payload", payload)]))).otherwise(F.col("value"))
    made = _drafts(rows.withColumn("raw", kept), "codex", content, human, parent)
    return made.drop("raw_json").withColumnRenamed("raw", "raw_json")


def qwen(rows: DataFrame, human: str | None = None, base_time: str = BASE_TIME) -> DataFrame:
    """Drafts from transcripts of generative parts, one JSON object a line."""
    rows = _timed(rows.where(F.try_parse_json("value").isNotNull()), "timestamp", base_time)
    kind, sub = _get("type"), F.coalesce(_get("subtype"), F.lit("untyped"))
    turn = kind.isin("user", "assistant", "tool_result") & _get("message").isNotNull() & _get("timestamp").isNotNull()
    empty = F.coalesce(F.forall(F.from_json(_get("message.parts"), ARRAY), lambda x: _is_text(F.try_variant_get(x, "$.text", "variant")) & (F.trim(F.try_variant_get(x, "$.text", "string")) == "")), F.lit(True))
    first = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = F.first(F.when((kind == "system") & (sub == "parent_session"), F.coalesce(_get("systemPayload.parentSessionId"), _get("systemPayload.sessionId"))), ignorenulls=True).over(first)
    system = kind == "system"
    rows = rows.withColumns({
        "above": above,
        "kind": F.when(turn & empty, "").when(turn, "conversation_turn").when(system & sub.isin(*QWEN_FILES), "file_snapshot").when(system & sub.isin(*QWEN_STATE), "session_state").when(system & sub.isin(*QWEN_INJECTION), "context_injection").when(system, "activity").otherwise("unrecognized"),
        "who": F.when(turn & (kind == "user"), "human").when(turn & (kind == "assistant"), "agent").when(system & sub.isin(*QWEN_HUMAN), "human").otherwise("system"),
        "actor_id": F.when(turn & (kind == "assistant"), F.nullif(_get("model"), F.lit(""))),
        "model": F.nullif(_get("model"), F.lit("")),
        "version": F.nullif(_get("version"), F.lit("")),
        "session": F.coalesce(_get("sessionId"), _stem()),
        "conversation": F.concat(F.lit("qwen-code:"), F.coalesce(_get("sessionId"), _stem())),
    })
    obj = without(F.from_json("value", OBJECT), *QWEN_ENVELOPE)
    message = json_object([("role", quoted(_get("message.role"))), ("blocks", blocks("message.parts", _part))])
    states = F.from_json(_get("systemPayload.snapshot.fileStates"), OBJECT)
    files = F.transform(F.map_entries(states), lambda e: F.to_json(put(F.coalesce(F.from_json(F.to_json(e["value"]), OBJECT), F.from_json(F.lit("{}"), OBJECT)), [("path", quoted(e["key"]))])))
    rest = F.coalesce(without(F.from_json(_get("systemPayload.snapshot"), OBJECT), "fileStates"), F.from_json(F.lit("{}"), OBJECT))
    snapshot = F.to_json(put(rest, [("operation", F.lit('"snapshot"')), ("files", F.concat(F.lit("["), F.coalesce(F.array_join(files, ","), F.lit("")), F.lit("]")))]))
    content = (
        F.when(turn, message)
        .when(system & (sub == QWEN_FILES[0]), snapshot)
        .when(system & sub.isin(*QWEN_FILES), F.to_json(put(obj, [("operation", quoted(sub))])))
        .when(system & sub.isin(*QWEN_STATE), F.to_json(put(obj, [("state_type", quoted(sub))])))
        .when(system & sub.isin(*QWEN_INJECTION), F.to_json(put(obj, [("injection_type", quoted(sub))])))
        .when(system, F.to_json(put(lift(obj, "content"), [("activity_type", quoted(F.concat(F.lit("system/"), sub)))])))
        .otherwise(json_object([("unrecognized_type", quoted(F.coalesce(kind, F.lit("(untyped)"))))]))
    )
    parent = F.when(F.col("above").isNotNull() & (F.col("above") != F.col("session")), F.concat(F.lit("qwen-code:"), "above"))
    return _drafts(rows.where("kind <> ''"), "qwen-code", content, human, parent)


class Log:
    """What a write-ahead log has come to: each message's place (by first sighting), the live ones in order, facts of its headers and patches.

    A record is, in this precedence, a rewind to a message, a message (its last version
    counts), a patch, or a header (it names its session and project).  A snapshot, the
    messages of a patch, withdraws live messages it lacks and gives the live ones its
    order.  Records of mutations are told without their lists of messages.
    """

    def __init__(self, place: dict[str, int] | None = None, live: list[str] = (), count: int = 0):
        self.place, self.live, self.count = dict(place or {}), dict.fromkeys(live), count
        self.facts: dict = {}

    def _sight(self, message):
        if isinstance(message, dict) and isinstance(message.get("id"), str):
            name = message["id"]
            if name not in self.place:
                self.place[name], self.count = self.count, self.count + 1
            self.live.setdefault(name)
            yield self.place[name], "message", message, message

    def _note(self, kind: str, fields: dict, record: dict):
        self.count += 1
        yield self.count - 1, kind, fields, record

    def take(self, text: str):
        """(place, kind, fields, record) of each message that a record states, and of what else it does."""
        try:
            record = json.loads(text)
        except ValueError:
            return
        if not isinstance(record, dict):
            return
        bare = lambda x: {k: v for k, v in x.items() if k != "messages"}
        target, patch = record.get("$rewindTo"), record.get("$set")
        if isinstance(target, str):
            ids = list(self.live)
            kept = ids[: ids.index(target)] if target in self.live else []
            self.live = dict.fromkeys(kept)
            yield from self._note("rewind", {"rewind_to": target, "removed_messages": ids[len(kept) :], "resolved": len(kept) < len(ids) and ids[len(kept)] == target}, record)
        elif isinstance(record.get("id"), str):
            yield from self._sight(record)
        elif isinstance(patch, dict):
            stored = record
            if isinstance(patch.get("messages"), list):
                stored = record | {"$set": bare(patch)}
                kept = {m["id"] for m in patch["messages"] if isinstance(m, dict) and isinstance(m.get("id"), str)}
                if gone := [i for i in self.live if i not in kept]:
                    yield from self._note("snapshot_drop", {"removed_messages": gone, "kept_message_count": len(kept)}, stored)
                self.live = {}
                for m in patch["messages"]:
                    yield from self._sight(m)
            self.facts.update(bare(patch))
            if bare(patch):
                yield from self._note("metadata", bare(patch), stored)
        elif isinstance(record.get("sessionId"), str) and isinstance(record.get("projectHash"), str):
            self.facts.update(bare(record))
            for m in record["messages"] if isinstance(record.get("messages"), list) else []:
                yield from self._sight(m)
            yield from self._note("metadata", bare(record), bare(record))


def replay(records: list[str]) -> dict:
    """What a write-ahead log leaves: messages (seq, record) by first sighting, mutations (seq, kind, fields, record) in order, rewound ids, metadata."""
    log, messages, mutations = Log(), {}, []
    for text in records:
        for seq, kind, fields, record in log.take(text):
            if kind == "message":
                messages[seq] = record
            else:
                mutations.append((seq, kind, fields, record))
    return {"messages": sorted(messages.items()), "mutations": mutations, "rewound": sorted(log.place.keys() - log.live.keys()), "facts": log.facts}


def gemini_log(rows: DataFrame) -> DataFrame:
    """(file, seq, what, value, raw, rewound, named, began) of replayed logs; what is message, rewind, snapshot_drop or metadata."""

    def run(key, table):
        made = replay(table.sort_by("seq")["value"].to_pylist())
        gone, text = set(made["rewound"]), lambda x: json.dumps(x, ensure_ascii=False)
        out = [(s, "message", text(m), text(m), m["id"] in gone) for s, m in made["messages"]]
        out += [(s, kind, text(fields), text(record), False) for s, kind, fields, record in made["mutations"]]
        cols = list(zip(*out)) if out else [()] * 5
        facts = [x if isinstance(x := made["facts"].get(k), str) and x else None for k in ("sessionId", "startTime")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        found = [pa.array([key[0].as_py()] * len(out), pa.string())] + [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array([x] * len(out), pa.string()) for x in facts]
        return pa.table(found, names=["file", "seq", "what", "value", "raw", "rewound", "named", "began"])

    return rows.groupBy("file").applyInArrow(run, "file string, seq long, what string, value string, raw string, rewound boolean, named string, began string")


def gemini(rows: DataFrame, human: str | None = None, base_time: str = BASE_TIME) -> DataFrame:
    """Drafts from replayed logs; messages with a call that still runs wait, unless they were rewound.

    A log in a folder of its chats that is named by a session is of a sub-session of it.
    """
    log = _timed(gemini_log(rows), "timestamp", base_time)
    calls = F.from_json(_get("toolCalls"), ARRAY)
    done = F.coalesce(F.forall(calls, lambda c: F.try_variant_get(c, "$.result", "variant").isNotNull() | F.coalesce(F.try_variant_get(c, "$.status", "string").isin("success", "error", "cancelled", "canceled"), F.lit(False))), F.lit(True))
    log = log.where((F.col("what") != "message") | done | F.col("rewound"))
    kind, text = _get("type"), F.coalesce(_get("content"), F.lit(""))
    message, notice = F.col("what") == "message", kind.isin(*GEMINI_NOTICES)
    harness = F.coalesce(text.startswith(GEMINI_HARNESS[0]) | text.startswith(GEMINI_HARNESS[1]), F.lit(False))
    name = F.coalesce("named", _stem())
    log = log.withColumns({
        "occurred_at": F.when(message, F.col("occurred_at")).otherwise(F.coalesce("began", F.lit(base_time))),
        "kind": F.when(message & kind.isin("user", "gemini"), "conversation_turn").when(message & notice & (F.trim(text) != ""), "conversation_turn").when(message & notice, "activity").when(message, "unrecognized").when(F.col("what") == "metadata", "session_state").otherwise("activity"),
        "who": F.when(message & (kind == "gemini"), "agent").when(message & (kind == "user") & ~harness, "human").when(F.col("what") == "rewind", "human").otherwise("system"),
        "actor_id": F.when(message & (kind == "gemini"), _get("model")), "model": _get("model"), "session": name, "conversation": F.concat(F.lit("gemini-cli:"), name),
    })
    raw = lambda x, path: F.to_json(F.try_variant_get(x, path, "variant"))
    thought = lambda x: F.coalesce(F.try_variant_get(x, "$.description", "string"), F.try_variant_get(x, "$.subject", "string"))
    think = F.transform(F.filter(F.from_json(_get("thoughts"), ARRAY), lambda x: F.coalesce(F.trim(thought(x)) != "", F.lit(False))), lambda x: json_object([("type", F.lit('"thinking"')), ("text", quoted(thought(x))), ("subject", quoted(F.nullif(F.try_variant_get(x, "$.subject", "string"), F.lit(""))))]))
    use = F.transform(calls, lambda c: json_object([("type", F.lit('"tool_use"')), ("id", raw(c, "$.id")), ("name", raw(c, "$.name")), ("input", raw(c, "$.args"))]))
    got = F.transform(F.filter(calls, lambda c: F.try_variant_get(c, "$.result", "variant").isNotNull()), lambda c: json_object([("type", F.lit('"tool_result"')), ("tool_use_id", raw(c, "$.id")), ("name", raw(c, "$.name")), ("content", raw(c, "$.result")), ("is_error", F.when(F.try_variant_get(c, "$.status", "string") == "error", "true"))]))
    none = F.array().cast("array<string>")
    own = F.substring(blocks("content", _part), 2, 1 << 30)
    own = F.array_compact(F.array(F.nullif(own.substr(F.lit(1), F.length(own) - 1), F.lit(""))))
    # parts that hold calls or thoughts say the same as the fields beside them
    held = F.coalesce(F.exists(F.from_json(_get("content"), ARRAY), lambda x: F.try_variant_get(x, "$.functionCall", "variant").isNotNull() | F.coalesce(F.try_variant_get(x, "$.thought", "boolean"), F.lit(False))), F.lit(False))
    beside = lambda x: F.when((kind == "gemini") & ~held, F.coalesce(x, none)).otherwise(none)
    every = F.array_join(F.concat(beside(think), own, beside(use), F.when(kind == "gemini", F.coalesce(got, none)).otherwise(none)), ",")
    role = F.when(kind == "gemini", '"model"').when(kind == "user", '"user"').otherwise('"system"')
    obj = F.from_json("value", OBJECT)
    content = (
        F.when(F.col("kind") == "conversation_turn", json_object([("role", role), ("blocks", F.concat(F.lit("["), every, F.lit("]")))]))
        .when(message & notice, json_object([("activity_type", quoted(F.concat(F.lit("notice/"), kind)))]))
        .when(message, json_object([("unrecognized_type", quoted(F.coalesce(kind, F.lit("(untyped)"))))]))
        .when(F.col("what") == "metadata", F.to_json(put(obj, [("state_type", F.lit('"metadata"'))])))
        .otherwise(F.to_json(put(obj, [("activity_type", quoted(F.col("what")))])))
    )
    above = F.nullif(F.regexp_extract("file", r"/chats/([^/]+)/[^/]+$", 1), F.lit(""))
    parent = F.when(above.isNotNull() & (above != name), F.concat(F.lit("gemini-cli:"), above))
    return _drafts(log.withColumn("parent", parent), "gemini-cli", content, human, F.col("parent"), by_line=False).drop("raw_json").withColumnRenamed("raw", "raw_json")


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, seq, value, closed, begin, size) of files that are one JSON document each: a document is one line."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    first = F.lit(0).cast("long")
    return whole.select("file", first.alias("seq"), "value", F.lit(True).alias("closed"), first.alias("begin"), "size")


def opencode(spark: SparkSession, *paths: str, human: str | None = None, base_time: str = BASE_TIME) -> DataFrame:
    """Drafts from export files; see opencode_sessions."""
    return opencode_sessions(documents(spark, *paths), human, base_time)


def opencode_sessions(rows: DataFrame, human: str | None = None, base_time: str = BASE_TIME) -> DataFrame:
    """Drafts from exports (file, value), one JSON document a session: a draft a part, numbered through the session.

    A part whose call still runs waits; a blank text makes nothing.  A part's number
    is the time in its id, where all ids of the session have one and no two the same,
    else its place; its time is its own, its call's or its message's.
    """
    docs = rows.select("file", F.col("value").alias("doc"))
    head = F.struct(_get("info.id", "doc").alias("session"), _get("info.parentID", "doc").alias("above"), F.nullif(_get("info.version", "doc"), F.lit("")).alias("version"))
    rows = docs.select("file", head.alias("h"), F.posexplode(F.from_json(_get("messages", "doc"), ARRAY)).alias("m", "message")).select("file", "h", "m", F.to_json("message").alias("message"))
    rows = rows.select("file", "h", "m", "message", F.posexplode(F.from_json(_get("parts", "message"), ARRAY)).alias("p", "part"))
    rows = rows.select("file", "h.*", "message", "m", "p", F.to_json("part").alias("value"))
    session = Window.partitionBy("file")
    stamped = F.conv(F.nullif(F.regexp_extract(F.coalesce(_get("id"), F.lit("")), "^prt_([0-9a-f]{12})", 1), F.lit("")), 16, 10).cast("long")
    rows = rows.withColumns({"stamped": stamped, "place": (F.row_number().over(session.orderBy("m", "p")) - 1).cast("long")})
    usable = F.size(F.collect_set("stamped").over(session)) == F.count("*").over(session)
    rows = rows.withColumn("seq", F.when(usable, F.col("stamped")).otherwise(F.col("place")))
    kind, status, role = _get("type"), _get("state.status"), _get("info.role", "message")
    rows = rows.where(~((kind == "tool") & ~F.coalesce(status.isin("completed", "error"), F.lit(False)))).where(~(kind.isin("text", "reasoning") & (F.trim(F.coalesce(_get("text"), F.lit(""))) == "")))
    stamp = lambda x: F.date_format(F.timestamp_millis(x.cast("long")).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    step = kind.isin("step-start", "step-finish", "patch")
    turn = kind.isin("text", "reasoning", "tool")
    model = F.coalesce(_get("info.modelID", "message"), _get("info.model.modelID", "message"))
    rows = rows.withColumns({
        "occurred_at": F.coalesce(stamp(_get("time.start")), stamp(_get("state.time.start")), stamp(_get("info.time.created", "message")), F.lit(base_time)),
        "kind": F.when(turn, "conversation_turn").when(step, "activity").otherwise("unrecognized"),
        "who": F.when(step | kind.isin("reasoning", "tool") | (role == "assistant"), "agent").when(turn & (role == "user"), "human").otherwise("system"),
        "provider": F.nullif(F.coalesce(_get("info.providerID", "message"), _get("info.model.providerID", "message")), F.lit("")),
        "actor_id": F.when(role == "assistant", model), "model": model, "conversation": F.concat(F.lit("opencode:"), "session"),
    })
    raw = lambda path: F.to_json(F.try_variant_get(F.try_parse_json("value"), f"$.{path}", "variant"))
    text = json_object([("type", F.when(kind == "reasoning", '"thinking"').otherwise('"text"')), ("text", raw("text"))])
    use = json_object([("type", F.lit('"tool_use"')), ("id", raw("callID")), ("name", raw("tool")), ("input", raw("state.input"))])
    result = json_object([("type", F.lit('"tool_result"')), ("tool_use_id", raw("callID")), ("content", F.coalesce(raw("state.output"), raw("state.error"))), ("is_error", F.when(status == "error", "true"))])
    said = json_object([("role", quoted(role)), ("blocks", F.concat(F.lit("["), F.when(kind == "tool", F.concat_ws(",", use, result)).otherwise(text), F.lit("]")))])
    obj = without(F.from_json("value", OBJECT), "id", "type", "messageID", "sessionID")
    content = F.when(turn, said).when(step, F.to_json(put(obj, [("activity_type", quoted(kind))]))).otherwise(json_object([("unrecognized_type", quoted(F.coalesce(kind, F.lit("(untyped)"))))]))
    return _drafts(rows, "opencode", content, human, F.when(F.col("above").isNotNull(), F.concat(F.lit("opencode:"), "above")), by_line=False)


def opencode_links(rows: DataFrame) -> DataFrame:
    """(session, parent) of exports (file, value), for descendants()."""
    return rows.select(_get("info.id").alias("session"), _get("info.parentID").alias("parent"))


def descendants(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """(session) of roots (session) and all sub-sessions below them, from links (session, parent)."""
    links = sessions.where("parent is not null").select(F.col("parent").alias("src"), F.col("session").alias("dst"))
    return graph.closure(links, roots.select(F.col("session").alias("node"))).select(F.col("node").alias("session"))
