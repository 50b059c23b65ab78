"""Redaction: rules and exact values replaced by marks that carry a fingerprint, with records of what was replaced."""

from __future__ import annotations

import json
import pickle
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.canonical import canonical_json, dumps, event_id, fingerprint
from tracelake.functions.exact import Values, chosen, replaced
from tracelake.functions.rules import Rule, compiled, has_sign, print_of, rules_for
from tracelake.functions.workers import trimmed
from tracelake.operators import scanning
from tracelake.shared import settle, share

RULESET = "v1"


def mark(rule: str, print_: Column) -> Column:
    return F.concat(F.lit(f"[REDACTED:{rule}:"), print_, F.lit("]"))


class Redactor:
    """Exact values and rules put to strings: values first, by one automaton (see functions.exact), then the rules in order, each on what the one before it left.

    Entropy rules never redact.
    """

    def __init__(self, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None):
        self.exact = Values(exact or {})
        self.rules = [r for r in (rules_for("capture") if rules is None else rules) if not r.gated]

    def __bool__(self) -> bool:
        return bool(self.exact or self.rules)

    def text(self, s: str) -> tuple[str, list[tuple[str, str]]]:
        """A text redacted, and (rule, fingerprint) of what was replaced: of values by their place, then rule by rule."""
        done: list[tuple[str, str]] = []
        if self.exact and (found := self.exact.found(s)):
            s, done = replaced(s, chosen(s, found), self.exact.names)
        low = s.lower()
        for rule in self.rules:
            if not has_sign(rule, low):
                continue

            def put(m: re.Match, rule=rule) -> str:
                done.append((rule.id, print_of(m.group())))
                return f"[REDACTED:{rule.id}:{done[-1][1]}]"

            changed = compiled(rule.pattern).sub(put, s)
            if changed != s:
                s, low = changed, changed.lower()
        return s, done

    def tree(self, value, path: str, kind: str | None, done: list[tuple[str, str, str]]):
        """A parsed JSON value with its strings redacted; keys stay.  done gets (rule, fingerprint, path)."""
        if isinstance(value, str):
            if scanning.exempt(kind, path):
                return value
            value, found = self.text(value)
            done += [(*x, path) for x in found]
            return value
        if isinstance(value, list):
            return [self.tree(x, f"{path}/{i}", kind, done) for i, x in enumerate(value)]
        if isinstance(value, dict):
            return {k: self.tree(x, f"{path}/{k}", kind, done) for k, x in value.items()}
        return value


#: Bytes beyond which a redactor is sent to executors once, not with every task.
LARGE = 256 << 10
#: Bytes of values that one automaton holds; more are dealt to several.
AUTOMATON = 16 << 20


class _Sent:
    """A redactor as tasks get it: within their function, or broadcast where it is large."""

    def __init__(self, spark: SparkSession, by: Redactor):
        size = len(pickle.dumps(by)) if by.exact else 0
        self.by, self.shared = (by, None) if size <= LARGE else (None, share(spark, by))

    def __call__(self) -> Redactor:
        return self.by if self.shared is None else self.shared.value


_PAIRS = pa.list_(pa.struct([("rule", pa.string()), ("fingerprint", pa.string())]))


def redact(rows: DataFrame, text: str, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with the text redacted, and an array redacted of (rule, fingerprint) behind; see Redactor."""
    sent, at = _Sent(rows.sparkSession, Redactor(rules, exact)), rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("redacted array<struct<rule:string,fingerprint:string>>").fields])

    def run(batches):
        by = sent()
        for b in batches:
            made = [(None, []) if t is None else by.text(t) for t in b.column(at).to_pylist()]
            cols = [*b.columns, pa.array([[{"rule": r, "fingerprint": f} for r, f in d] for _, d in made], _PAIRS)]
            cols[at] = pa.array([t for t, _ in made], b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "redacted"])

    return rows.mapInArrow(trimmed(run), schema)


def scrub(rows: DataFrame, text: str, values: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """rows with every occurrence of the values (rule, value) in a text replaced, and an array redacted of (rule, fingerprint) behind.

    For values that are a table, of any size.  Their bytes are summed first: up to ``most``
    they make one automaton, which is broadcast; more are dealt by hash into automata of about
    that size, which pass over the texts one after another, and the occurrences of all passes
    are chosen among at the end.  So the time goes with the texts and the passes, not with the
    number of values.  Null and empty values are none; a value of several rules belongs to
    the first by name.  Rules come in the order of their names.
    """
    spark, at = rows.sparkSession, rows.columns.index(text)
    values = values.where("value <> ''").groupBy("value").agg(F.min("rule").alias("rule"))
    sizes = values.agg(F.sum(F.octet_length("value")).alias("bytes"), F.collect_set("rule").alias("rules")).first()
    names = sorted(sizes["rules"])  # a few names
    shards = max(1, -(-(sizes["bytes"] or 0) // most))
    dealt = values.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards)))
    kind = "array<struct<rule:int,start:int,finish:int>>"
    spans = pa.list_(pa.struct([("rule", pa.int32()), ("start", pa.int32()), ("finish", pa.int32())]))
    given = rows.withColumn("_found", F.array().cast(kind))

    def finder(shard: int):
        groups: dict[str, list[str]] = {name: [] for name in names}
        for r in dealt.where(F.col("shard") == shard).select("rule", "value").toLocalIterator():  # most bytes, about
            groups[r.rule].append(r.value)
        shared = share(spark, Values(groups))

        def run(batches):
            for b in batches:
                old = b.column(b.num_columns - 1).to_pylist()
                new = [x + [{"rule": g, "start": i, "finish": j} for g, i, j in shared.value.found(t or "")] for x, t in zip(old, b.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, spans)], b.schema.names)

        return run

    for shard in range(shards):
        given = given.mapInArrow(trimmed(finder(shard)), given.schema)
        if shard + 1 < shards:
            given = settle(given, "scrub")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("redacted array<struct<rule:string,fingerprint:string>>").fields])

    def put(batches):
        for b in batches:
            texts, found = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            made = [(t, []) if not x else replaced(t, chosen(t, [(y["rule"], y["start"], y["finish"]) for y in x]), names) for t, x in zip(texts, found)]
            cols = [*b.columns[:-1], pa.array([[{"rule": r, "fingerprint": f} for r, f in d] for _, d in made], _PAIRS)]
            cols[at] = pa.array([t for t, _ in made], b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "redacted"])

    return given.mapInArrow(trimmed(put), schema)


def canonical_events(drafts: DataFrame, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None) -> DataFrame:
    """Drafts with their JSON columns redacted leaf by leaf and in canonical form, each parsed once.

    Strings of the content and of the raw line are redacted, keys never; what was
    replaced is recorded behind the redactions there, with its path.  rules None are
    capture's, an empty list with no exact values leaves texts as they are.  Content that
    is no JSON becomes null.
    """
    sent = _Sent(drafts.sparkSession, Redactor(rules, exact))
    parts = [(drafts.columns.index(c), path) for c, path in scanning.JSON_PARTS if c in drafts.columns]
    kind, old = drafts.columns.index("kind"), drafts.columns.index("redactions")

    def run(batches):
        by = sent()
        for b in batches:
            cols, kinds = list(b.columns), b.column(kind).to_pylist()
            done = [[] for _ in kinds]
            for at, path in parts:
                new = []
                for text, k, d in zip(b.column(at).to_pylist(), kinds, done):
                    try:
                        new.append(None if text is None else dumps(by.tree(json.loads(text), path, k, d) if by else json.loads(text)))
                    except (ValueError, RecursionError):
                        new.append(None)
                cols[at] = pa.array(new, cols[at].type)
            if any(done):
                new = [(x or []) + [{"rule": r, "ruleset": RULESET, "fingerprint": f, "path": p} for r, f, p in d] if d else x for x, d in zip(b.column(old).to_pylist(), done)]
                cols[old] = pa.array(new, cols[old].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return drafts.mapInArrow(trimmed(run), drafts.schema)


def redact_events(events: DataFrame, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None) -> DataFrame:
    """Events with their contents and raw lines redacted, leaf by leaf, before the id is made."""
    done = canonical_events(events, rules, exact)
    return done.withColumn("id", event_id()) if "id" in events.columns else done


def redact_stored(events: DataFrame, ids: DataFrame, shared: DataFrame | None, pattern: str | None = None, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, companions): stored events redacted after the fact under their old ids, and a redaction event each.

    Events that a replica already shares are refused, and all where it is not known what is
    shared (None; a ledger without replicas shares an empty table); so is a pattern that
    matches nothing.  Without a pattern the whole content gives way to one mark.
    """
    if shared is None:
        raise ValueError("it is not known whether the events are shared already")
    targets = ids.select("id").distinct()
    if not targets.join(shared.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("an event to redact is shared already")
    before = F.greatest(F.coalesce(F.size("redactions"), F.lit(0)), F.lit(0))
    hit = events.join(targets, "id", "left_semi").withColumn("_before", before)
    if pattern is None:
        whole = F.to_json(F.struct(mark("manual", fingerprint(F.col("content_json"))).alias("text")))
        new = F.struct(F.lit("manual").alias("rule"), F.lit(RULESET).alias("ruleset"), fingerprint(F.col("content_json")).alias("fingerprint"), F.lit("content").alias("path"))
        none = F.array().cast(events.schema["redactions"].dataType)
        changed = hit.withColumns({"redactions": F.concat(F.coalesce("redactions", none), F.array(new)), "content_json": whole})
        if "raw_json" in events.columns:
            changed = changed.withColumn("raw_json", F.lit(None).cast("string"))
    else:
        changed = canonical_events(hit, [Rule("manual", "capture", pattern)])
        if not changed.where(before <= F.col("_before")).isEmpty():
            raise ValueError("the pattern matches nothing in an event")
    new = F.slice("redactions", F.col("_before") + 1, F.size("redactions"))
    noted = changed.withColumn("_prints", new.getField("fingerprint"))
    changed = changed.select(events.columns)
    why = [] if reason is None else [F.lit(reason).alias("reason")]
    note = F.to_json(F.struct(F.col("id").alias("target"), F.lit("all" if pattern is None else "pattern").alias("mode"), F.col("_prints").alias("fingerprints"), *why))
    companions = noted.withColumns({"kind": F.lit("redaction"), "content_json": canonical_json(note), "links": F.array(F.struct(F.lit("redacts").alias("rel"), F.col("id").alias("target"))), "redactions": F.lit(None).cast(events.schema["redactions"].dataType)})
    companions = companions.withColumn("id", event_id()).select(events.columns)
    kept = events.join(targets, "id", "left_anti").select(events.columns)
    return kept.unionByName(changed).unionByName(companions), companions
