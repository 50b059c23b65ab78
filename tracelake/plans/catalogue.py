"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import rules
from tracelake.functions.canonical import fingerprint
from tracelake.operators import drift, graph, ledger, reading, redaction, scanning
from tracelake.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.finalize(tables.chat(_read(spark, sf_dir, "conversations")))


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.activity(_read(spark, sf_dir, "events"))


CHAT = r"""
chat0 AS (SELECT conv_id, turn AS seq, role, text, 'chat:' || conv_id AS conversation,
  strftime(TIMESTAMP '2026-01-01' + (conv_id * 60 + turn) * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.%gZ') AS occurred_at,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'agent' ELSE 'system' END AS actor,
  CASE WHEN role = 'assistant' THEN 'model-' || (conv_id % 3) END AS model FROM conversations),
chat AS (SELECT *, 'conversation_turn' AS kind, 'chat' AS source, 'ev1-' || sha256('{"actor":{"type":"' || actor || '"},"content":{"role":"' || role || '","text":' || to_json(text) || '},"conversation":{"id":"' || conversation
  || '","seq":' || seq || '},"kind":"conversation_turn","occurred_at":"' || occurred_at || '","schema":"tracelake/v1","source":"chat"}') AS id FROM chat0)
"""
ACTIVITY = r"""
activity AS (SELECT event_id, 'app:' || user_id AS conversation, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, 'activity' AS kind,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS occurred_at, event_type AS activity_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, 'system' AS actor FROM events)
"""


@query(f"""WITH {CHAT}
SELECT conversation, count(*) AS events, min(occurred_at) AS first_at, max(occurred_at) AS last_at, 'chat' AS source,
  coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '-') AS models FROM chat GROUP BY conversation""")
def conv_summary(spark, sf_dir):
    return reading.conversations(_chat(spark, sf_dir))


@query(f"""WITH {CHAT} SELECT model, count(DISTINCT conversation) AS conversations, count(*) AS turns FROM chat WHERE model IS NOT NULL GROUP BY model""")
def conv_models(spark, sf_dir):
    chat = _chat(spark, sf_dir).where("producer.model is not null")
    return chat.groupBy(F.col("producer.model").alias("model")).agg(F.count_distinct("conversation.id").alias("conversations"), F.count("*").alias("turns"))


@query(f"""WITH {CHAT} SELECT id, conversation, seq, dense_rank() OVER (PARTITION BY conversation ORDER BY seq)::INTEGER AS position FROM chat""")
def turn_positions(spark, sf_dir):
    return reading.with_position(_chat(spark, sf_dir)).select("id", F.col("conversation.id").alias("conversation"), F.col("conversation.seq").alias("seq"), "position")


@query(f"""WITH {CHAT} SELECT id, conversation, seq, occurred_at, actor FROM chat""")
def event_ids_chat(spark, sf_dir):
    return _chat(spark, sf_dir).select("id", F.col("conversation.id").alias("conversation"), F.col("conversation.seq").alias("seq"), "occurred_at", F.col("actor.type").alias("actor"))


def _log(events: DataFrame) -> DataFrame:
    return events.select("id", F.col("conversation.id").alias("conversation"), F.col("conversation.seq").alias("seq"), "kind")


@query(f"""WITH {CHAT} SELECT id, conversation, seq, kind FROM chat WHERE model = 'model-1'""")
def log_by_model(spark, sf_dir):
    return _log(reading.where(_chat(spark, sf_dir), kind="conversation_turn", source="chat", model="model-1"))


@query(f"""WITH {CHAT} SELECT id, conversation, seq, kind FROM chat WHERE starts_with(conversation, 'chat:1')""")
def log_conv_prefix(spark, sf_dir):
    return _log(reading.where(_chat(spark, sf_dir), conversation="chat:1"))


@query(f"""WITH {CHAT}, {ACTIVITY}, u AS (SELECT conversation, seq, kind, actor FROM chat UNION ALL SELECT conversation, seq, kind, CASE WHEN k % 4 = 0 THEN 'human' ELSE actor END FROM activity)
SELECT conversation, seq, kind, actor FROM u WHERE kind <> 'activity' OR actor = 'human'""")
def log_display_filter(spark, sf_dir):
    activity = _activity(spark, sf_dir)
    human = F.get_json_object("content_json", "$.k").cast("long") % 4 == 0
    activity = activity.withColumn("actor", F.struct(F.when(human, "human").otherwise("system").alias("type"), F.lit(None).cast("string").alias("id")))
    both = tables.chat(_read(spark, sf_dir, "conversations")).unionByName(activity.drop("event_id"))
    return both.where(reading.displayed()).select(F.col("conversation.id").alias("conversation"), F.col("conversation.seq").alias("seq"), "kind", F.col("actor.type").alias("actor"))


@query(f"""WITH {ACTIVITY} SELECT event_id, conversation, seq, occurred_at, activity_type, k, value FROM activity""")
def events_as_activity(spark, sf_dir):
    get = lambda name, kind: F.get_json_object("content_json", f"$.{name}").cast(kind).alias(name)
    rows = _activity(spark, sf_dir)
    return rows.select("event_id", F.col("conversation.id").alias("conversation"), F.col("conversation.seq").cast("long").alias("seq"), "occurred_at", get("activity_type", "string"), get("k", "long"), get("value", "double"))


@query(f"""WITH {CHAT}, c AS (SELECT id, conv_id, i AS copy, (conv_id + i * 2 + seq) % 3 AS depth, occurred_at || '+' || ((i * 7 + seq) % 4) AS recorded_at FROM chat, range(3) t(i))
SELECT id, depth, recorded_at, copy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC, recorded_at, copy) AS n FROM c) WHERE n = 1""")
def dedup_redaction_depth(spark, sf_dir):
    seq, conv = F.col("conversation.seq"), F.substring("conversation.id", 6, 20).cast("long")
    rows = _chat(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    one = F.struct(*[F.lit(x).alias(x) for x in ("rule", "ruleset", "fingerprint", "path")])
    rows = rows.withColumn("redactions", F.array_repeat(one, ((conv + F.col("copy") * 2 + seq) % 3).cast("int")))
    rows = rows.withColumn("recorded_at", F.concat("occurred_at", F.lit("+"), (F.col("copy") * 7 + seq) % 4))
    return reading.collapse(rows, tie="copy").select("id", F.size("redactions").cast("long").alias("depth"), "recorded_at", F.col("copy").cast("long").alias("copy"))


def _anchored(spark, sf_dir) -> DataFrame:
    return _chat(spark, sf_dir).withColumn("anchor", F.concat(F.lit("a"), F.substring("conversation.id", 6, 20).cast("long") % 5))


@query(f"""WITH {CHAT} SELECT 'a' || (conv_id % 5) AS anchor, id FROM chat WHERE (conv_id + seq) % 2 = 1""")
def append_new_rows(spark, sf_dir):
    rows = _anchored(spark, sf_dir)
    even = (F.substring("conversation.id", 6, 20).cast("long") + F.col("conversation.seq")) % 2 == 0
    return ledger.new_rows(rows.unionByName(rows), rows.where(even)).select("anchor", "id")


@query(f"""WITH {CHAT}, r AS (SELECT 'a' || (conv_id % 5) AS anchor, id FROM chat WHERE conv_id % 3 <> 0 UNION SELECT 'a' || (conv_id % 5), id FROM chat WHERE conv_id % 3 <> 1)
SELECT anchor, count(*) AS lines FROM r GROUP BY anchor""")
def replica_union(spark, sf_dir):
    rows = _anchored(spark, sf_dir).withColumn("conv", F.substring("conversation.id", 6, 20).cast("long"))
    a, b = (rows.where(F.col("conv") % 3 != i).select("anchor", "id", "content_json") for i in (0, 1))
    return ledger.union(a, b).groupBy("anchor").agg(F.count("*").alias("lines"))


@query(f"""WITH {CHAT}, r AS (SELECT 'a' || (conv_id % 5) AS anchor, id FROM chat WHERE conv_id % 3 = 2 UNION SELECT 'a' || (conv_id % 5), id FROM chat WHERE conv_id % 5 < 2)
SELECT anchor, id FROM r""")
def scoped_push(spark, sf_dir):
    rows = _anchored(spark, sf_dir).select("anchor", "id", "conversation")
    remote = rows.where(F.substring("conversation.id", 6, 20).cast("long") % 3 == 2)
    scope = rows.where(F.col("anchor").isin("a0", "a1")).select("anchor")
    return ledger.push(rows, remote, scope).select("anchor", "id")


# Documents with a secret of each shape put behind some of the texts.
INJECT = """coalesce(text, '') || case doc_id % 7 when 0 then ' password=' || substr(sha2(cast(doc_id as string), 256), 1, 12) when 1 then ' https://user:' || substr(sha2(cast(doc_id as string), 256), 1, 10) || '@host.example'
 when 2 then ' Authorization: Bearer ' || sha2(cast(doc_id as string), 256) when 3 then ' ghp_' || substr(sha2(cast(doc_id as string), 256), 1, 36) else '' end"""
INJECTED = "injected AS (SELECT doc_id, " + INJECT.replace("sha2(cast(doc_id as string), 256)", "sha256(doc_id::VARCHAR)") + " AS text FROM documents)"
KEYWORD = r"""(?i)(?:password|passwd|secret|api_key|apikey|access_token|auth_token|credentials?)["'']?\s*[:=]\s*["'']?[^\s"''`(){}\[\]<>;,$\\]{8,}"""
URL, BEARER, GITHUB = r"(?i)[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s@]{4,}@", r"(?i)bearer\s+[A-Za-z0-9_\-.=]{20,}", "ghp_[A-Za-z0-9]{36,255}"
MARKED = f"NOT regexp_matches(m, '{rules.MARKERS}')"
FOUND = (
    "found AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, text, '{name}' AS rule, unnest(regexp_extract_all(text, '{p}')) AS m FROM injected" for name, p in (("keyword-assignment", KEYWORD), ("url-credentials", URL), ("bearer-token", BEARER), ("github-token", GITHUB)))
    + f") WHERE rule = 'github-token' OR {MARKED})"
)


def _injected(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.expr(INJECT).alias("text"))


def _findings(spark, sf_dir) -> DataFrame:
    return scanning.scan(_injected(spark, sf_dir), "text", "standard")


@query(f"WITH {INJECTED}, {FOUND} SELECT doc_id, rule, substr(sha256(m), 1, 12) AS fingerprint FROM found")
def scan_standard(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", "rule", "fingerprint")


@query(f"""WITH {INJECTED}, {FOUND} SELECT doc_id, rule, (strpos(text, m) - 1)::INTEGER AS start, (strpos(text, m) - 1 + length(m))::INTEGER AS "end" FROM found""")
def findings_span_offsets(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", "rule", "start", "end")


@query(f"""WITH {INJECTED}, {FOUND}, p AS (SELECT doc_id, rule, substr(sha256(m), 1, 12) AS fingerprint, strpos(text, m) AS place FROM found)
SELECT fingerprint, arg_min(rule, struct_pack(a := doc_id, b := place, c := rule)) AS rule, count(*) AS sites, count(DISTINCT doc_id) AS events,
  array_to_string(list_sort(list(DISTINCT doc_id))[1:3], ',') AS first_events FROM p GROUP BY fingerprint""")
def findings_grouped(spark, sf_dir):
    return scanning.grouped(_findings(spark, sf_dir), "doc_id")


ALLOW = "allowed AS (SELECT substr(sha256('password=' || substr(sha256(doc_id::VARCHAR), 1, 12)), 1, 12) AS fingerprint FROM documents WHERE doc_id % 2 = 0 UNION SELECT substr(sha256('ghp_' || substr(sha256(doc_id::VARCHAR), 1, 36)), 1, 12) FROM documents WHERE doc_id % 3 = 0)"


@query(f"""WITH {INJECTED}, {FOUND}, {ALLOW} SELECT doc_id, rule, fingerprint FROM (SELECT doc_id, rule, substr(sha256(m), 1, 12) AS fingerprint FROM found) WHERE fingerprint NOT IN (SELECT fingerprint FROM allowed)""")
def findings_allowlisted(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    sha = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    lists = [docs.where(F.col("doc_id") % n == 0).select(fingerprint(F.concat(F.lit(head), F.substring(sha, 1, size))).alias("fingerprint")) for n, head, size in ((2, "password=", 12), (3, "ghp_", 36))]
    return scanning.outstanding(_findings(spark, sf_dir), scanning.allowlist(*lists)).select("doc_id", "rule", "fingerprint")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9+/_=-]{24,}')) AS token FROM documents),
c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT doc_id, token FROM t)),
n AS (SELECT doc_id, token, ch, count(*)::DOUBLE AS n FROM c GROUP BY ALL)
SELECT doc_id, token, round(-sum(n / length(token) * log2(n / length(token))), 6) AS entropy FROM n GROUP BY doc_id, token""")
def entropy_per_token(spark, sf_dir):
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z0-9+/_=-]{24,})"), F.lit(1))))
    tokens = _read(spark, sf_dir, "documents").select("doc_id", found.alias("token")).distinct()
    return tokens.select("doc_id", "token", F.round(rules.entropy(F.col("token")), 6).alias("entropy"))


@query(f"""WITH {INJECTED}, r AS (SELECT doc_id, regexp_extract_all(text, '{GITHUB}') AS m, text FROM injected)
SELECT doc_id, sha256(CASE WHEN len(m) = 0 THEN text ELSE replace(text, m[1], '[REDACTED:github-token:' || substr(sha256(m[1]), 1, 12) || ']') END) AS text_sha256, len(m)::INTEGER AS spans FROM r""")
def redact_text(spark, sf_dir):
    done = redaction.redact(_injected(spark, sf_dir), "text")
    return done.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.size("redacted").alias("spans"))


@query(f"""WITH {CHAT}, s AS (SELECT *, CASE WHEN seq % 3 = 1 THEN 'stated-' || (seq % 2) END AS stated FROM chat)
SELECT conversation, seq, coalesce(last_value(stated IGNORE NULLS) OVER (PARTITION BY conversation ORDER BY seq ROWS UNBOUNDED PRECEDING),
  first_value(stated IGNORE NULLS) OVER (PARTITION BY conversation ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS in_force FROM s""")
def asof_model(spark, sf_dir):
    rows = _chat(spark, sf_dir).select(F.col("conversation.id").alias("conversation"), F.col("conversation.seq").alias("seq"))
    rows = rows.withColumn("stated", F.when(F.col("seq") % 3 == 1, F.concat(F.lit("stated-"), F.col("seq") % 2)))
    return reading.carry_forward(rows, ["conversation"], ["seq"], "stated").select("conversation", "seq", F.col("stated_in_force").alias("in_force"))


SHA = "substr(sha256('commit-' || ({})), 1, 40)"
EDGES = f"edges AS (SELECT {SHA.format('event_id')} AS src, {SHA.format('event_id // 2')} AS dst FROM events WHERE event_id > 0 UNION SELECT {SHA.format('event_id')}, {SHA.format('event_id // 3')} FROM events WHERE event_id > 0 AND event_id % 5 = 0)"
REACH = f"reach AS (SELECT {SHA.format('event_id')} AS sha FROM events WHERE event_id % 997 = 5 UNION SELECT dst FROM reach JOIN edges ON sha = src)"


def _sha(k):
    return F.substring(F.sha2(F.concat(F.lit("commit-"), k.cast("string")).cast("binary"), 256), 1, 40)


def _commits(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    parents = F.array_compact(F.array(F.when(k > 0, _sha(F.floor(k / 2))), F.when((k > 0) & (k % 5 == 0), _sha(F.floor(k / 3)))))
    return _read(spark, sf_dir, "events").select("event_id", _sha(k).alias("sha"), F.array_distinct(parents).alias("parents"))


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT sha FROM reach")
def reachable_commits(spark, sf_dir):
    commits = _commits(spark, sf_dir)
    return graph.ancestors(commits, commits.where("event_id % 997 = 5"))


@query(f"""WITH RECURSIVE {EDGES}, {REACH}, maps AS (SELECT {SHA.format('event_id')} AS successor, {SHA.format('event_id * 3 + 1')} AS superseded FROM events WHERE event_id % 11 IN (0, 2, 5, 7) UNION SELECT {SHA.format('event_id')}, {SHA.format('event_id + 8')} FROM events WHERE event_id % 11 IN (0, 2, 5, 7)),
seen AS (SELECT sha FROM reach UNION SELECT superseded FROM seen JOIN maps ON sha = successor) SELECT sha FROM seen""")
def reanchor_fixpoint(spark, sf_dir):
    commits, k = _commits(spark, sf_dir), F.col("event_id")
    maps = commits.where((k % 11).isin(0, 2, 5, 7))
    maps = maps.select(F.col("sha").alias("anchor"), F.array(_sha(k * 3 + 1), _sha(k + 8)).alias("superseded"), F.col("sha").alias("successor"))
    return graph.reanchor(graph.ancestors(commits, commits.where("event_id % 997 = 5")), maps)


_REVS = "(3, 40, 41, 500, 777, 900)"
_MAPPED = "event_id % 11 IN (0, 5, 6)"


@query(f"""WITH RECURSIVE {EDGES}, start AS (SELECT 'r' || event_id AS rev, {SHA.format('event_id')} AS sha FROM events WHERE event_id IN {_REVS}),
view AS (SELECT rev, sha FROM start UNION SELECT rev, dst FROM view JOIN edges ON sha = src),
maps AS (SELECT {SHA.format('event_id')} AS anchor, CASE event_id % 3 WHEN 0 THEN {SHA.format('event_id')} WHEN 1 THEN {SHA.format('event_id - 1')} ELSE {SHA.format('event_id + 1000011')} END AS successor, {SHA.format('event_id + 1000000')} AS superseded FROM events WHERE {_MAPPED}),
open AS (SELECT rev, successor, superseded FROM maps JOIN view ON anchor = sha),
seen AS (SELECT rev, sha FROM view UNION SELECT seen.rev, superseded FROM seen JOIN open ON sha = successor AND seen.rev = open.rev) SELECT rev, sha FROM seen""")
def scope_by_rev(spark, sf_dir):
    """Six revisions, each with its history and the mappings that it alone has both sides of; mappings hang on themselves, on the commit before, and on one another."""
    commits, k = _commits(spark, sf_dir), F.col("event_id")
    revisions = commits.where(k.isin(3, 40, 41, 500, 777, 900)).select(F.concat(F.lit("r"), k).alias("rev"), "sha")
    successor = F.when(k % 3 == 0, F.col("sha")).when(k % 3 == 1, _sha(k - 1)).otherwise(_sha(k + 1000011))
    maps = commits.where((k % 11).isin(0, 5, 6)).select(F.col("sha").alias("anchor"), F.array(_sha(k + 1000000)).alias("superseded"), successor.alias("successor"))
    return graph.scopes(commits, revisions, maps)


@query(f"""WITH top AS (SELECT min(event_id + 1) AS k FROM events WHERE event_id + 1 NOT IN (SELECT event_id FROM events)) SELECT {SHA.format('i')} AS sha FROM range(0, (SELECT k + 1 FROM top)) r(i)""")
def reanchor_chain(spark, sf_dir):
    """Each event is a mapping that brings the next commit; every other one is held by the first commit of all."""
    events, k = _read(spark, sf_dir, "events"), F.col("event_id")
    zero = F.lit(0).cast("long")
    maps = events.select(_sha(F.when(k % 2 == 0, k).otherwise(zero)).alias("anchor"), F.array(_sha(k + 1)).alias("superseded"), _sha(k).alias("successor"))
    return graph.reanchor(spark.range(1).select(_sha(F.col("id")).alias("sha")), maps)


@query("""WITH b AS (SELECT 'b' || user_id AS branch, 't' || max(event_id) AS tree, 'p' || min(event_id) AS patch_id FROM events GROUP BY user_id),
c AS (SELECT 'c' || event_id AS sha, 't' || (event_id - event_id % 3 * (event_id % 2)) AS tree, 'p' || (event_id - event_id % 3 * (event_id % 2)) AS patch_id FROM events),
m AS (SELECT branch, sha, 'tree' AS method, 0 AS r FROM b JOIN c ON b.tree = c.tree UNION ALL SELECT branch, sha, 'patch-id', 1 FROM b JOIN c ON b.patch_id = c.patch_id),
x AS (SELECT branch, count(DISTINCT sha) AS n, min(sha) AS sha, min(method) AS method FROM (SELECT *, min(r) OVER (PARTITION BY branch) AS least FROM m) WHERE r = least GROUP BY branch)
SELECT b.branch, CASE WHEN n = 1 THEN sha END AS successor, CASE WHEN n = 1 THEN method END AS method, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'detected' ELSE 'ambiguous' END AS outcome FROM b LEFT JOIN x ON b.branch = x.branch""")
def detect_squash(spark, sf_dir):
    events, k = _read(spark, sf_dir, "events"), F.col("event_id")
    named = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    branches = events.groupBy(named("b", F.col("user_id")).alias("branch")).agg(named("t", F.max(k)).alias("tree"), named("p", F.min(k)).alias("patch_id"))
    made = k - k % 3 * (k % 2)
    candidates = events.select(named("c", k).alias("sha"), named("t", made).alias("tree"), named("p", made).alias("patch_id"))
    return graph.detect_squash(branches, candidates)


@query("""WITH n AS (SELECT 'n' || event_id AS sha, event_id // 2 AS p FROM events WHERE event_id % 4 = 0), c AS (SELECT 'c' || event_id AS sha, event_id - event_id % 2 AS p FROM events WHERE event_id % 4 <> 0)
SELECT n.sha, min(c.sha) AS successor FROM n JOIN c ON n.p = c.p GROUP BY n.sha HAVING count(DISTINCT c.sha) = 1""")
def detect_rebase(spark, sf_dir):
    events, k = _read(spark, sf_dir, "events"), F.col("event_id")
    noted = events.where(k % 4 == 0).select(F.concat(F.lit("n"), k).alias("sha"), F.floor(k / 2).alias("patch_id"))
    return graph.detect_rebase(noted, events.where(k % 4 != 0).select(F.concat(F.lit("c"), k).alias("sha"), (k - k % 2).alias("patch_id")))


#: A third of all changes are to one path, whatever the branch.
CHANGE = "CASE WHEN event_id % 3 = 0 THEN 'f0' ELSE 'f' || (event_id // 4) END AS path, CASE WHEN event_id % 3 = 0 THEN event_id // 120 ELSE event_id // 4 END AS patch FROM events"


@query(f"""WITH l AS (SELECT DISTINCT 'b' || (event_id // 60) AS branch, {CHANGE} WHERE event_id % 2 = 0),
r AS (SELECT DISTINCT 'c' || (event_id // 40) AS sha, {CHANGE} WHERE event_id % 2 = 1),
s AS (SELECT branch, sha, count(*) AS common, count(*) FILTER (l.patch = r.patch) AS identical FROM l JOIN r ON l.path = r.path GROUP BY branch, sha),
x AS (SELECT s.branch, s.sha, identical, identical / (a + b - common) AS score FROM s JOIN (SELECT branch, count(*) AS a FROM l GROUP BY branch) USING (branch) JOIN (SELECT sha, count(*) AS b FROM r GROUP BY sha) USING (sha) WHERE identical > 0)
SELECT branch, sha, identical, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY score DESC, sha)::INTEGER AS rank FROM x) WHERE rank <= 3""")
def file_overlap_top3(spark, sf_dir):
    events, k = _read(spark, sf_dir, "events"), F.col("event_id")
    hot, part = k % 3 == 0, lambda n: F.floor(k / n)
    path, patch = F.when(hot, "f0").otherwise(F.concat(F.lit("f"), part(4))), F.when(hot, part(120)).otherwise(part(4))
    side = lambda i, name, head, n: events.where(k % 2 == i).select(F.concat(F.lit(head), part(n)).alias(name), path.alias("path"), patch.alias("patch_id")).distinct()
    return graph.file_overlap(side(0, "branch", "b", 60), side(1, "sha", "c", 40))


@query("""SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type""")
def drift_counts(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.lit("unrecognized").alias("kind"), F.to_json(F.struct(F.col("event_type").alias("unrecognized_type"))).alias("content_json"))
    return drift.counts(rows)


@query("""WITH RECURSIVE c AS (SELECT conv_id, CASE WHEN conv_id % 10 <> 0 AND conv_id // 2 <> conv_id THEN conv_id // 2 END AS parent, count(*) AS events FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, conv_id AS root, 0 AS level, events FROM c WHERE parent IS NULL UNION ALL SELECT c.conv_id, t.root, t.level + 1, c.events FROM c JOIN t ON c.parent = t.conv_id)
SELECT 'chat:' || conv_id AS conversation, 'chat:' || root AS root, level, events FROM t""")
def subconversation_tree(spark, sf_dir):
    conv = F.substring("conversation.id", 6, 20).cast("long")
    half = F.floor(conv / 2)
    parent = F.when((conv % 10 != 0) & (half != conv), F.concat(F.lit("chat:"), half))
    rows = _chat(spark, sf_dir).withColumn("conversation", F.struct(F.col("conversation.id").alias("id"), F.col("conversation.seq").alias("seq"), parent.alias("parent")))
    return reading.tree(rows).select("conversation", "root", F.col("level").cast("int").alias("level"), "events")


LINES = """lines AS (SELECT 'f' || conv_id AS file, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS seq, count(*) OVER (PARTITION BY conv_id) AS n, conv_id, turn FROM conversations)"""


def _lines(spark, sf_dir) -> DataFrame:
    """One JSON line a turn; each third file's last line is cut off, and one line in seven is broken."""
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id")
    rows = _read(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(by.orderBy("turn")) - 1).withColumn("n", F.count("*").over(by))
    line = F.to_json(F.struct("role", "text"))
    torn = (F.col("seq") == F.col("n") - 1) & (F.col("conv_id") % 3 == 0)
    bad = (F.col("conv_id") + F.col("seq")) % 7 == 0
    value = F.when(torn | bad, line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    return rows.select(F.concat(F.lit("f"), "conv_id").alias("file"), "seq", value.alias("value"), (F.col("conv_id") % 3 != 0).alias("closed"))


@query(f"""WITH {LINES}, s AS (SELECT file, seq, n, CASE WHEN seq = n - 1 AND conv_id % 3 = 0 THEN 'torn' WHEN (conv_id + seq) % 7 = 0 THEN 'bad' ELSE 'sound' END AS state FROM lines)
SELECT file, count(*) FILTER (state = 'sound') AS sound, count(*) FILTER (state = 'bad') AS bad, count(*) FILTER (state = 'torn') AS torn, max(seq) + 1 - count(*) FILTER (state = 'torn') AS cursor FROM s GROUP BY file""")
def torn_tail(spark, sf_dir):
    states = ledger.parsed(_lines(spark, sf_dir))
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    tally = states.groupBy("file").agg(count("sound"), count("bad"), count("torn"))
    return tally.join(ledger.cursors(states), "file").select("file", "sound", "bad", "torn", F.col("count").cast("long").alias("cursor"))


@query(f"""WITH {LINES} SELECT file, seq FROM lines WHERE seq >= CASE WHEN conv_id % 4 = 0 THEN 0 WHEN CASE WHEN conv_id % 4 = 1 THEN 50 ELSE conv_id % 4 END > n THEN 0 WHEN conv_id % 4 = 1 THEN 50 ELSE conv_id % 4 END""")
def cursor_resume(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    conv = F.substring("file", 2, 20).cast("long")
    cursors = lines.select("file").distinct().where(conv % 4 != 0).select("file", F.when(conv % 4 == 1, 50).otherwise(conv % 4).alias("count"))
    return ledger.resume(lines, cursors).select("file", F.col("seq").cast("long").alias("seq"))


@query(f"""WITH {INJECTED}, {FOUND}, p AS (SELECT doc_id, rule, text, m, strpos(text, m) - 1 AS a FROM found)
SELECT doc_id, rule, sha256(substr(text, greatest(a - 40, 0) + 1, a - greatest(a - 40, 0)) || '<redacted>' || substr(text, a + length(m) + 1, 40)) AS around FROM p""")
def context_window(spark, sf_dir):
    found = _findings(spark, sf_dir).join(_injected(spark, sf_dir), "doc_id")
    around = scanning.context(F.col("text"), F.col("start"), F.col("end"), 40)
    return found.select("doc_id", "rule", F.sha2(around.cast("binary"), 256).alias("around"))


@query(f"""WITH {CHAT}, t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, dense_rank() OVER (PARTITION BY conversation ORDER BY seq) AS position FROM chat)
SELECT id, occurred_at || '  conversation_turn  ' || rpad(role, 9, ' ') || '  ' || substr(conversation, 1, 28) || '#' || position || '  ' || CASE WHEN length(flat) > 100 THEN substr(flat, 1, 97) || '...' ELSE flat END AS line FROM t""")
def log_lines(spark, sf_dir):
    return reading.with_position(_chat(spark, sf_dir)).select("id", reading.log_line().alias("line"))


@query("""WITH d AS (SELECT doc_id, strftime(TIMESTAMP '2026-01-01' + doc_id * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.%gZ') AS occurred_at, text, lang, source FROM documents),
i AS (SELECT doc_id, 'ev1-' || sha256('{"actor":{"type":"system"},"content":{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","text":' || to_json(text) || '},"kind":"document","occurred_at":"' || occurred_at || '","schema":"tracelake/v1","source":"documents"}') AS target FROM d)
SELECT l.doc_id, target, quality, toxic FROM labels l JOIN i ON l.doc_id = i.doc_id""")
def annotation_links(spark, sf_dir):
    rows = tables.annotation(_read(spark, sf_dir, "labels"), _read(spark, sf_dir, "documents"))
    get = lambda name: F.get_json_object("content_json", f"$.{name}").cast("int").alias(name)
    return rows.select("doc_id", F.col("links")[0]["target"].alias("target"), get("quality"), get("toxic"))


from tracelake.plans import captures, upkeep  # noqa: E402, F401  they register more queries here
