"""Queries that run the transcript readers and the ledger's upkeep over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.canonical import canonical_json, event_id, fingerprint
from tracelake.operators import drift, graph, ledger, redaction, scanning
from tracelake.plans.catalogue import ACTIVITY, CHAT, FOUND, INJECTED, _activity, _anchored, _chat, _injected, _read, query
from tracelake.shared import foldered_files, named_files, put_text, shared_dir
from tracelake.sources import addressed, tables, transcripts
from tracelake.streaming import capture, wal

TURNS = """turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


def _turns(spark, sf_dir) -> DataFrame:
    by = Window.partitionBy("conv_id")
    return _read(spark, sf_dir, "conversations").withColumns({"seq": (F.row_number().over(by.orderBy("turn")) - 1).cast("long"), "n": F.count("*").over(by)})


def _files(rows: DataFrame, line) -> DataFrame:
    return rows.select(F.concat(F.lit("/t/f"), "conv_id", F.lit(".jsonl")).alias("file"), "seq", line.alias("value"), F.lit(True).alias("closed"))


def _said(events: DataFrame, *more) -> DataFrame:
    text = F.get_json_object("content_json", "$.blocks[0].text")
    return events.select(F.col("conversation.id").alias("conversation"), F.col("conversation.seq").alias("seq"), "kind", F.col("actor.type").alias("actor"), F.col("producer.model").alias("model"), text.alias("text"), *more)


@query(f"""WITH {TURNS} SELECT 'claude-code:s' || conv_id || CASE WHEN seq % 5 = 4 THEN '#agent:a' || (seq % 3) ELSE '' END AS conversation, seq,
  CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'session_state' ELSE 'conversation_turn' END AS kind,
  CASE WHEN role = 'assistant' THEN 'agent' WHEN role = 'user' AND seq % 5 <> 4 THEN 'human' ELSE 'system' END AS actor,
  CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 3) END AS model, CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN seq % 5 = 4 THEN 'claude-code:s' || conv_id END AS parent FROM turns""")
def capture_claude(spark, sf_dir):
    turn = F.col("role").isin("user", "assistant")
    message = F.struct(F.col("role").alias("role"), F.when(F.col("role") == "assistant", F.concat(F.lit("m"), F.col("conv_id") % 3)).alias("model"), F.col("text").alias("content"))
    side = F.when(F.col("seq") % 5 == 4, True)
    state = (F.col("role") == "system") & (F.col("conv_id") % 2 == 0)
    line = F.to_json(F.struct(
        F.when(turn, F.col("role")).when(state, F.lit("mode")).otherwise("system").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.lit("2026-01-01T00:00:00.000Z").alias("timestamp"),
        side.alias("isSidechain"), F.when(side, F.concat(F.lit("a"), F.col("seq") % 3)).alias("agentId"), F.when(turn, message).alias("message"), F.when(~turn & ~state, F.col("text")).alias("content"),
    ))
    events = transcripts.claude(_files(_turns(spark, sf_dir), line))
    return _said(events, F.col("conversation.parent").alias("parent"))


@query(f"""WITH {TURNS}, s AS (SELECT *, CASE WHEN role = 'system' THEN 'm' || turn END AS stated FROM turns),
t AS (SELECT *, 'codex:x' || conv_id AS conversation, role = 'assistant' AND seq % 3 > 0 AS split,
  coalesce(last_value(stated IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING), first_value(stated IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS model FROM s)
SELECT conversation, seq, CASE WHEN role = 'system' THEN 'session_state' ELSE 'conversation_turn' END AS kind, CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'human' ELSE 'system' END AS actor, model, CASE WHEN role <> 'system' THEN text END AS text,
  CASE WHEN role = 'system' THEN NULL WHEN NOT split THEN role WHEN seq % 3 = 1 THEN 'reasoning_summary' ELSE 'agent_message' END AS role FROM t
UNION ALL SELECT conversation, seq, 'reasoning', 'agent', model, NULL, NULL FROM t WHERE split""")
def capture_codex(spark, sf_dir):
    """Rollouts of messages; a third of an agent's turns are summaries of sealed reasoning, a third messages to another agent with a sealed block."""
    context = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("m"), "turn").alias("model")).alias("payload")))
    block = F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("data"))
    hidden = F.struct(F.lit("encrypted_content").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("sealed").alias("data"))
    item = lambda kind, *fields: F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit(kind).alias("type"), *fields).alias("payload")))
    agent, third = F.col("role") == "assistant", F.col("seq") % 3
    value = F.when(F.col("role") == "system", context).when(agent & (third == 1), item("reasoning", F.array(block).alias("summary"), F.lit("sealed").alias("encrypted_content")))
    value = value.when(agent & (third == 2), item("agent_message", F.lit("a").alias("author"), F.array(block, hidden).alias("content"))).otherwise(item("message", "role", F.array(block).alias("content")))
    lines = _turns(spark, sf_dir).select(F.concat(F.lit("/t/x"), "conv_id", F.lit(".jsonl")).alias("file"), "seq", value.alias("value"), F.lit(True).alias("closed"))
    return _said(transcripts.codex(lines), F.get_json_object("content_json", "$.role").alias("role"))


@query(f"""WITH {TURNS} SELECT 'qwen-code:f' || conv_id AS conversation, seq, CASE WHEN role = 'system' THEN 'activity' ELSE 'conversation_turn' END AS kind,
  CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'human' WHEN 'system' THEN CASE WHEN conv_id % 2 = 0 THEN 'human' ELSE 'system' END END AS actor, NULL::VARCHAR AS model, text FROM turns""")
def capture_qwen(spark, sf_dir):
    parts = F.struct("role", F.array(F.struct("text")).alias("parts"))
    turn = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2026-01-01T00:00:00.000Z").alias("timestamp"), parts.alias("message")))
    system = F.to_json(F.struct(F.lit("system").alias("type"), F.when(F.col("conv_id") % 2 == 0, "slash_command").otherwise("ui_telemetry").alias("subtype"), F.col("text").alias("content")))
    return _said(transcripts.qwen(_files(_turns(spark, sf_dir), F.when(F.col("role") == "system", system).otherwise(turn))))


_REPLAYED = f"""WITH {TURNS} SELECT 'f' || conv_id AS file, count(DISTINCT seq // 2) AS messages, 1::BIGINT AS mutations, CASE WHEN max(n) >= 5 THEN count(DISTINCT seq // 2) - 2 ELSE count(DISTINCT seq // 2) END AS rewound FROM turns GROUP BY conv_id"""


def _logs(spark, sf_dir):
    """A log writes each message twice, then rewinds to its third message, or to one that is not there."""
    rows = _turns(spark, sf_dir)
    said = F.to_json(F.struct(F.concat(F.lit("m"), F.floor(F.col("seq") / 2)).alias("id"), F.lit("user").alias("type"), F.col("text").alias("content")))
    back = rows.where("seq = n - 1").select("conv_id", (F.col("n") + 1).alias("seq"), F.lit('{"$rewindTo":"m2"}').alias("value"))
    log = rows.select("conv_id", "seq", said.alias("value")).unionByName(back)
    return log.select(F.concat(F.lit("f"), "conv_id").alias("file"), "seq", "value")


def _replayed(made):
    return made.groupBy("file").agg(F.count_if(F.col("what") == "message").alias("messages"), F.count_if(F.col("what") != "message").alias("mutations"), F.count_if("rewound").alias("rewound"))


@query(_REPLAYED)
def wal_replay(spark, sf_dir):
    return _replayed(transcripts.gemini_log(_logs(spark, sf_dir)))


@query(_REPLAYED)
def stream_wal_replay(spark, sf_dir):
    """The same logs, of which three micro-batches bring four lines, four more, and the rest."""
    folder, rows = shared_dir(spark, "wal"), _logs(spark, sf_dir)
    for batch in (F.col("seq") < 4, (F.col("seq") >= 4) & (F.col("seq") < 8), F.col("seq") >= 8):
        rows.where(batch).write.mode("append").parquet(f"{folder}/in")
        changed = wal.capture(spark, f"{folder}/in", f"{folder}/out", f"{folder}/marks")
    return _replayed(wal.folded(changed))


@query(f"""WITH {TURNS} SELECT conv_id, seq FROM turns WHERE NOT (role = 'assistant' AND (conv_id + seq) % 3 = 0)""")
def settled_only(spark, sf_dir):
    status = F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("seq")) % 3 == 0), "running").otherwise("success")
    rows = _turns(spark, sf_dir).withColumn("calls", F.array(F.struct(F.lit(None).cast("string").alias("result"), status.alias("status"))))
    return rows.where(ledger.settled(F.col("calls"))).select("conv_id", "seq")


_LINE = "concat(conv_id, '|', turn, '|', role, '|', replace(coalesce(text, ''), chr(10), ' '))"  # for Spark and DuckDB


@query(f"""WITH l AS (SELECT 'f' || (conv_id % 5) AS file, conv_id, turn, {_LINE} AS value FROM conversations)
SELECT file, row_number() OVER w - 1 AS line, (sum(strlen(value) + 1) OVER w - strlen(value) - 1)::BIGINT AS "begin", (sum(strlen(value) + 1) OVER w)::BIGINT AS "end", sha256(value) AS value_sha256 FROM l WINDOW w AS (PARTITION BY file ORDER BY conv_id, turn, value)""")
def line_offsets(spark, sf_dir):
    """All turns as lines of five files, read by blocks of 64 KB: where each line lies."""
    rows = _read(spark, sf_dir, "conversations").select(F.concat(F.lit("f"), F.col("conv_id") % 5).alias("name"), F.struct("conv_id", "turn", F.expr(_LINE).alias("value")).alias("place"), F.expr(_LINE).alias("value"))
    folder, block = shared_dir(spark, "offsets"), "spark.sql.files.maxPartitionBytes"
    named_files(rows, folder)
    held = spark.conf.get(block)
    spark.conf.set(block, "64k")
    try:
        found = addressed.lines(spark, folder)
    finally:
        spark.conf.set(block, held)
    name = F.regexp_extract("file", "([^/]+)$", 1)
    return found.select(name.alias("file"), F.col("seq").alias("line"), "begin", "end", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"))


@query("""WITH t AS (SELECT conv_id % 9 AS f, conv_id, turn FROM conversations)
SELECT 'f' || f || '.jsonl' AS file, CASE WHEN f % 3 = 0 THEN 'read' ELSE 'same' END AS state, count(*) AS events FROM t WHERE f % 3 = 0 OR turn % 4 <> 3 GROUP BY f
UNION ALL SELECT 'broken.jsonl.gz', 'quarantined', 0""")
def swept_files(spark, sf_dir):
    """Nine transcripts are captured; a third of them grow, a broken one appears: a sweep reads those, and sets the broken one aside."""
    rows = _read(spark, sf_dir, "conversations").withColumn("f", F.col("conv_id") % 9)
    line = F.to_json(F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.concat(F.lit("s"), "f").alias("sessionId"), F.lit("2026-01-01T00:00:00.000Z").alias("timestamp"), F.struct("role", F.concat("conv_id", F.lit("|"), "turn", F.lit("|"), F.coalesce("text", F.lit(""))).alias("content")).alias("message")))
    rows = rows.select("f", "turn", F.concat(F.lit("f"), "f", F.lit(".jsonl")).alias("name"), F.struct(F.col("turn") % 4 == 3, "conv_id", "turn").alias("place"), line.alias("value"))
    folder = shared_dir(spark, "sweep")
    run = lambda: capture.sweep(spark, f"{folder}/in", transcripts.claude, f"{folder}/ledger", f"{folder}/marks", f"{folder}/aside", adopt=True)
    named_files(rows.where("turn % 4 <> 3"), f"{folder}/in")
    run()
    named_files(rows.where("f % 3 = 0"), f"{folder}/in")
    put_text(spark, f"{folder}/in/broken.jsonl.gz", "no archive")
    name = F.regexp_extract("file", "([^/]+)$", 1)
    looked = run().select(name.alias("file"), "state")
    held = spark.read.parquet(f"{folder}/ledger").groupBy(F.concat(F.substring("producer.session_id", 2, 9).alias("f"), F.lit(".jsonl")).alias("n")).agg(F.count("*").alias("events"))
    there = transcripts.files(spark, f"{folder}/in").select(name.alias("file"))
    out = there.join(looked, "file", "left").join(held.withColumn("file", F.concat(F.lit("f"), "n")).drop("n"), "file", "left")
    return out.select("file", F.coalesce("state", F.lit("same")).alias("state"), F.coalesce("events", F.lit(0).cast("long")).alias("events"))


@query("""SELECT 'f' || conv_id AS file, sum(length(text)) AS size FROM conversations GROUP BY conv_id HAVING conv_id % 3 = 1""")
def stale_files(spark, sf_dir):
    """Files that grew: every third had no cursor, every third's cursor is at its end."""
    files = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"))
    name = F.concat(F.lit("f"), "conv_id").alias("file")
    seen = files.where("conv_id % 3 <> 0").select(name, F.when(F.col("conv_id") % 3 == 1, F.col("size") - 1).otherwise(F.col("size")).alias("size"))
    return ledger.stale(files.select(name, "size"), seen)


def _lost(spark, sf_dir) -> DataFrame:
    """Activity as a reader that does not know it would keep it."""
    rows = _activity(spark, sf_dir)
    content = F.to_json(F.struct(F.concat(F.lit("app/"), F.get_json_object("content_json", "$.activity_type")).alias("unrecognized_type")))
    rows = rows.withColumns({"kind": F.lit("unrecognized"), "content_json": canonical_json(content)}).drop("event_id")
    return rows.select(event_id().alias("id"), "*")


@query(f"""WITH {ACTIVITY} SELECT 'app/' || activity_type AS type, count(*) AS unrecognized, count(*) FILTER (activity_type = 'click') AS interpreted, count(*) FILTER (activity_type = 'click') AS supersessions, count(*) FILTER (activity_type <> 'click') AS left_open FROM activity GROUP BY activity_type""")
def renormalized(spark, sf_dir):
    """A reader learns one type: its events are interpreted and superseded, the rest stay open."""
    lost = _lost(spark, sf_dir)

    def convert(df):
        content = canonical_json(F.to_json(F.struct(F.substring(drift.unrecognized_type(), 5, 100).alias("activity_type"))))
        return df.where(drift.unrecognized_type() == "app/click").withColumns({"replaces": F.col("id"), "kind": F.lit("activity"), "content_json": content})

    made, notes = drift.renormalize(lost, convert)
    done = lost.select(drift.unrecognized_type().alias("type"), F.col("id").alias("target"))
    old = notes.select(F.col("links")[0]["target"].alias("target"), F.lit(1).alias("superseded"))
    read = made.select(F.concat(F.lit("app/"), F.get_json_object("content_json", "$.activity_type")).alias("type")).groupBy("type").agg(F.count("*").alias("interpreted"))
    tally = done.join(old, "target", "left").groupBy("type").agg(F.count("*").alias("unrecognized"), F.count("superseded").alias("supersessions"), F.count_if(F.col("superseded").isNull()).alias("left_open"))
    return tally.join(read, "type", "left").select("type", "unrecognized", F.coalesce("interpreted", F.lit(0).cast("long")).alias("interpreted"), "supersessions", "left_open")


@query("""WITH s AS (SELECT doc_id, 'subject ' || (doc_id % 50) || CASE WHEN doc_id % 3 = 0 THEN ' (#' || doc_id || ')' ELSE '' END AS subject FROM documents)
SELECT doc_id, TRY_CAST(nullif(regexp_extract(subject, '\\(#(\\d+)\\)\\s*$', 1), '') AS INTEGER) AS number FROM s""".replace("\\\\", "\\"))
def pull_request_numbers(spark, sf_dir):
    k = F.col("doc_id")
    subject = F.concat(F.lit("subject "), k % 50, F.when(k % 3 == 0, F.concat(F.lit(" (#"), k, F.lit(")"))).otherwise(""))
    return _read(spark, sf_dir, "documents").select("doc_id", subject.alias("subject")).select("doc_id", graph.pull_request().alias("number"))


@query("""WITH b AS (SELECT DISTINCT 'b' || (event_id // 40) AS branch, 'fix ' || (event_id // 3) || ';' AS subject FROM events WHERE event_id % 2 = 0),
c AS (SELECT 'c' || (event_id // 60) AS sha, 'Merged: ' || string_agg(DISTINCT 'fix ' || (event_id // 3) || ';', ' ') AS body FROM events WHERE event_id % 2 = 1 GROUP BY 1),
t AS (SELECT branch, count(*) AS total FROM b GROUP BY branch) SELECT b.branch, sha, count(*) AS hits, max(total) AS total FROM b JOIN c ON contains(body, subject) JOIN t ON t.branch = b.branch GROUP BY b.branch, sha""")
def subject_evidence(spark, sf_dir):
    """Every other event is a branch's commit, the rest are listed in the messages of candidates."""
    events, k = _read(spark, sf_dir, "events"), F.col("event_id")
    subject = F.concat(F.lit("fix "), F.floor(k / 3), F.lit(";"))
    branches = events.where(k % 2 == 0).select(F.concat(F.lit("b"), F.floor(k / 40)).alias("branch"), subject.alias("subject")).distinct()
    body = F.concat(F.lit("Merged: "), F.array_join(F.collect_set(subject), " "))
    candidates = events.where(k % 2 == 1).groupBy(F.concat(F.lit("c"), F.floor(k / 60)).alias("sha")).agg(body.alias("body"))
    return graph.subject_hits(branches, candidates)


@query(f"""WITH {INJECTED}, {FOUND} SELECT doc_id, rule, count(*) AS spans FROM found WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 GROUP BY doc_id, rule""")
def push_gate(spark, sf_dir):
    """Findings that block a push: a quarter of the events is shared, a third is out of scope."""
    anchor = F.when(F.col("doc_id") % 3 == 0, "out").otherwise("in").alias("anchor")
    local = _injected(spark, sf_dir).select("doc_id", anchor, F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("document").alias("kind"), F.lit("").alias("occurred_at"), F.struct(F.lit(None).cast("string").alias("id")).alias("conversation"), F.to_json(F.struct("text")).alias("content_json"))
    remote, scope = local.where("doc_id % 4 = 0"), local.where("anchor = 'in'").select("anchor").distinct()
    found = ledger.gate(local, remote, scope, spark.createDataFrame([], "fingerprint string"))
    return found.groupBy(F.substring("event_id", 2, 20).cast("long").alias("doc_id"), "rule").agg(F.count("*").alias("spans"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'the ', ''))) // 4 AS n FROM documents)
SELECT doc_id, n::INTEGER AS spans, sha256(replace(text, 'the ', '[REDACTED:known-secret:' || substr(sha256('the '), 1, 12) || ']')) AS text_sha256 FROM t""")
def scrub_exact_values(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = redaction.redact(docs, "text", exact={"known-secret": ["the "]})
    known = F.size(F.filter("redacted", lambda x: x["rule"] == "known-secret"))
    return done.select("doc_id", known.alias("spans"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(r"""WITH v AS (SELECT list(w ORDER BY length(w) DESC, w) AS v FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS w FROM benchmark)),
t AS (SELECT doc_id, list_reduce([coalesce(text, '')] || v, lambda s, w: replace(s, w, '[REDACTED:known-secret:' || substr(sha256(w), 1, 12) || ']')) AS text FROM documents, v)
SELECT doc_id, ((length(text) - length(replace(text, '[REDACTED:known-secret:', ''))) // 23)::INTEGER AS spans, sha256(text) AS text_sha256 FROM t""")
def scrub_many_values(spark, sf_dir):
    """Every word of eight letters and more of the benchmark as a secret, in all documents."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)))
    values = _read(spark, sf_dir, "benchmark").select(F.lit("known-secret").alias("rule"), words.alias("value"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = redaction.scrub(docs, "text", values)
    return done.select("doc_id", F.size("redacted").alias("spans"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN strlen(html) + 1 END AS bytes, CASE WHEN page_id % 2 = 0 THEN sha256(html || chr(10)) END AS digest FROM pages""")
def backup_digests(spark, sf_dir):
    """A snapshot of each page meets a cache of files, where every other page is."""
    pages, folder = _read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("v"), "page_id").alias("name"), "html"), shared_dir(spark, "cache")
    foldered_files(pages.where("page_id % 2 = 0").select("name", F.col("html").alias("value")), folder)
    backup = F.create_map(F.lit("page.html"), F.struct(F.col("name").alias("backupFileName")))
    line = F.to_json(F.struct(F.lit("file-history-snapshot").alias("type"), F.struct(backup.alias("trackedFileBackups")).alias("snapshot")))
    drafts = transcripts.claude(pages.select(F.lit("/t/pages.jsonl").alias("file"), F.col("page_id").alias("seq"), line.alias("value"), F.lit(True).alias("closed")))
    one = F.col("resolved")[0]
    return transcripts.resolved(drafts, transcripts.backup_digests(spark, folder, foldered=True)).select(F.col("conversation.seq").alias("page_id"), one["bytes"].alias("bytes"), one["sha256"].alias("digest"))


@query(f"""WITH {CHAT}, r AS (SELECT 'a' || (conv_id % 5) AS anchor, id, conversation, seq FROM chat WHERE conv_id % 5 IN (1, 2)) SELECT anchor, id FROM r UNION ALL SELECT NULL, id FROM chat WHERE conv_id % 5 = 0""")
def scoped_read(spark, sf_dir):
    from tracelake.operators import reading

    rows = _anchored(spark, sf_dir).withColumn("anchor", F.nullif(F.col("anchor"), F.lit("a0")))
    return reading.in_scope(rows, rows.select("anchor").where("anchor in ('a1', 'a2')")).select("anchor", "id")


@query(f"""WITH {CHAT}, t AS (SELECT conversation AS anchor, count(*) AS n, count(*) FILTER (conv_id % 3 = 0 AND seq = 1) AS gone, max(conv_id % 3) AS kind FROM chat GROUP BY conversation)
SELECT anchor, n AS local_lines, n - gone AS remote_lines FROM t WHERE gone > 0 OR kind = 2 UNION ALL SELECT 'only-there', 0, count(*) FROM chat WHERE seq = 0""")
def changed_anchors(spark, sf_dir):
    """Of two replicas by conversation: a third lack a line at the remote, a third differ in one, and the remote has an anchor more."""
    local = _chat(spark, sf_dir).withColumn("anchor", F.col("conversation.id"))
    kind, first = F.substring("conversation.id", 6, 20).cast("long") % 3, F.col("conversation.seq") == 0
    least = F.min("conversation.seq").over(Window.partitionBy("anchor"))
    odd = local.withColumn("media_type", F.when((kind == 2) & (F.col("conversation.seq") == least), "text/x"))
    remote = odd.where(~((kind == 0) & (F.col("conversation.seq") == 1))).unionByName(local.where(first).withColumn("anchor", F.lit("only-there")))
    return ledger.differing(local, remote.repartition(3))


@query(f"""WITH {CHAT} SELECT id, 'a9' AS anchor FROM chat WHERE conv_id % 5 = 0 UNION SELECT id, 'a' || (conv_id % 5) FROM chat WHERE conv_id % 5 <> 0""")
def pending_drained(spark, sf_dir):
    rows = _anchored(spark, sf_dir).withColumn("anchor", F.nullif(F.col("anchor"), F.lit("a0")))
    return ledger.drain(rows, "a9").select("id", "anchor")


@query("""SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint, sha256('{"text":' || to_json(text) || '}') AS canonical_sha256 FROM documents WHERE text IS NOT NULL""")
def canonical_documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    made = F.sha2(canonical_json(F.to_json(F.struct("text"))).cast("binary"), 256)
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"), made.alias("canonical_sha256"))


@query(f"""WITH {CHAT} SELECT id, 'content/text' AS path, length(text)::INTEGER AS size FROM chat UNION ALL SELECT id, 'content/role', length(role)::INTEGER FROM chat""")
def string_leaves(spark, sf_dir):
    rows = _chat(spark, sf_dir).select("id", F.explode(scanning.leaves("content_json")).alias("leaf"))
    return rows.select("id", "leaf.path", F.length("leaf.value").alias("size"))


@query(f"""WITH {CHAT} SELECT id, '' AS problems FROM chat""")
def validated(spark, sf_dir):
    return _chat(spark, sf_dir).select("id", F.array_join(tables.problems(), ",").alias("problems"))
