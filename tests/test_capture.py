"""Incremental capture from growing files and from a stream of files."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import drift
from tracelake.sources import transcripts
from tracelake.streaming import capture


def line(i):
    return json.dumps({"type": "user", "sessionId": "s", "timestamp": f"2026-01-01T00:00:0{i}.000Z", "message": {"role": "user", "content": f"m{i}"}})


def test_growing_file(spark, tmp_path):
    path, where, marks = tmp_path / "s.jsonl", str(tmp_path / "ledger"), str(tmp_path / "cursors")
    run = lambda: capture.catch_up(transcripts.lines(spark, str(path)), transcripts.claude, where, marks)
    path.write_text(line(0) + "\n" + line(1) + "\n" + line(2)[:30])
    assert run() == {"appended": 2, "deduped": 0}
    assert run() == {"appended": 0, "deduped": 0}
    path.write_text("\n".join(line(i) for i in range(5)) + "\n")
    assert run() == {"appended": 3, "deduped": 0}
    seqs = sorted(r.conversation.seq for r in spark.read.parquet(where).collect())
    assert seqs == [0, 1, 2, 3, 4]
    assert capture.catch_up(transcripts.lines(spark, str(path)), transcripts.claude, where, str(tmp_path / "lost"))["appended"] == 0


def test_stream_available_now(spark, tmp_path):
    folder, where = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    run = lambda name: capture.stream(spark, str(folder), transcripts.claude, where, str(tmp_path / name))
    (folder / "a.jsonl").write_text(line(0) + "\n" + line(1) + "\n")
    assert run("one") == {"appended": 2, "deduped": 0}
    (folder / "b.jsonl").write_text(line(0) + "\n" + json.dumps({"type": "odd"}) + "\n")
    assert run("one") == {"appended": 1, "deduped": 1}
    assert run("two") == {"appended": 0, "deduped": 4}
    assert [r.type for r in capture.unknown(spark.read.parquet(where)).collect()] == ["odd"]


def say(i, text, role="user", **more):
    return json.dumps({"type": role, "sessionId": "s", "timestamp": f"2026-01-01T00:00:{i:02d}.000Z", "message": {"role": role, "content": text}} | more)


def gemini_log():
    call = lambda status, **more: {"toolCalls": [{"id": "c", "name": "f", "args": {}, "status": status} | more]}
    m = lambda i, kind="user", **more: json.dumps({"id": f"m{i}", "type": kind, "timestamp": f"2026-01-01T00:00:{i:02d}.000Z", "content": f"t{i}"} | more)
    head = json.dumps({"sessionId": "g", "projectHash": "p", "startTime": "2026-01-01T00:00:00.000Z"})
    return [head, m(1), m(1), m(2, "gemini", **call("running")), m(3), m(2, "gemini", **call("success", result=[1])), m(3), json.dumps({"$rewindTo": "m3"}), m(4), json.dumps({"$set": {"messages": [{"id": "m4", "type": "user", "content": "t4", "timestamp": "2026-01-01T00:00:04.000Z"}], "title": "x"}}), m(5)]


def codex_log():
    item = lambda i: json.dumps({"type": "response_item", "timestamp": f"2026-01-01T00:00:{i:02d}.000Z", "payload": {"type": "message", "role": "user", "content": [{"type": "text", "text": f"t{i}"}]}})
    return [json.dumps({"type": "session_meta", "timestamp": "2026-01-01T00:00:00.000Z", "payload": {"id": "x", "cli_version": "1.2", "model_provider": "pp"}}), *map(item, range(1, 7))]


def qwen_log():
    return [json.dumps({"type": "user", "sessionId": "q", "timestamp": f"2026-01-01T00:00:{i:02d}.000Z", "message": {"role": "user", "parts": [{"text": f"t{i}"}]}}) for i in range(7)]


LOGS = {"claude": [say(i, f"t{i}") for i in range(7)], "codex": codex_log(), "qwen": qwen_log(), "gemini": gemini_log()}


@pytest.mark.parametrize("name,cuts", [("claude", 2), ("codex", 3), ("qwen", 2), ("gemini", 3), ("gemini", 99)])
def test_cuts_capture_the_same(spark, tmp_path, name, cuts):
    """However a file grows between captures, the ledger ends with what one capture of all of it gives."""
    reader, log = getattr(transcripts, name), LOGS[name]
    path = tmp_path / "s.jsonl"
    ends = sorted({-(-len(log) * i // min(cuts, len(log))) for i in range(1, min(cuts, len(log)) + 1)})

    def run(name, upto):
        path.write_text("".join(x + "\n" for x in log[:upto]))
        return capture.catch_up(transcripts.lines(spark, str(path)), reader, str(tmp_path / name), str(tmp_path / f"{name}-marks"))

    for end in ends:
        run("parts", end)
    assert run("parts", len(log)) == {"appended": 0, "deduped": 0}
    whole = run("whole", len(log))
    ids = [{r.id for r in spark.read.parquet(str(tmp_path / name)).collect()} for name in ("parts", "whole")]
    assert ids[0] == ids[1] and len(ids[1]) == whole["appended"] > 5


def test_exports_are_captured_as_they_change(spark, tmp_path):
    """An export is written anew with more in it; a call that ran is held back until it has ended."""
    path, where, marks = tmp_path / "o.json", str(tmp_path / "ledger"), str(tmp_path / "marks")
    part = lambda n, **x: {"id": f"prt_{n:012x}a"} | x
    tool = lambda status: part(2, type="tool", tool="t", callID="c", state={"status": status, "input": {}, "output": "o"})

    def run(*parts):
        path.write_text(json.dumps({"info": {"id": "o", "version": "0.9"}, "messages": [{"info": {"role": "assistant", "modelID": "m", "providerID": "pr", "time": {"created": 1767225600000}}, "parts": parts}]}))
        return capture.catch_up(transcripts.documents(spark, str(path)), transcripts.opencode_sessions, where, marks)["appended"]

    assert run(part(1, type="text", text="a"), tool("running")) == 1
    assert run(part(1, type="text", text="a"), tool("running")) == 0
    assert run(part(1, type="text", text="a"), tool("completed"), part(3, type="text", text="b")) == 2
    rows = spark.read.parquet(where).collect()
    assert sorted(r.conversation.seq for r in rows) == [1, 2, 3] and {(r.producer.source_version, r.producer.provider, r.producer.model) for r in rows} == {("0.9", "pr", "m")}


SECRETS = ["pa\"ss\\word-123", "two\nlines-secret", "a\\Eb-secret-value", "ghp_" + "a1" * 18]


def test_captured_secrets_are_redacted(spark, tmp_path):
    path, where = tmp_path / "s.jsonl", str(tmp_path / "ledger")
    path.write_text(say(1, "see " + " and ".join(SECRETS)) + "\n" + json.dumps({"type": "odd", "sessionId": "s", "note": {SECRETS[3]: SECRETS}}) + "\n")
    run = lambda: capture.catch_up(transcripts.lines(spark, str(path)), transcripts.claude, where, str(tmp_path / "marks"), exact={"known-secret": SECRETS[:3]})
    assert run() == {"appended": 2, "deduped": 0}
    rows = {r.kind: r for r in spark.read.parquet(where).collect()}
    said, odd = rows["conversation_turn"], rows["unrecognized"]
    text = json.loads(said.content_json)["blocks"][0]["text"]
    assert not any(x in text for x in SECRETS) and text.count("[REDACTED:known-secret:") == 3 and "[REDACTED:github-token:" in text
    assert {x.path for x in said.redactions} == {"content/blocks/0/text", "raw/data/message/content"} and len(said.redactions) == 8
    assert list(json.loads(odd.raw_json)["note"]) == [SECRETS[3]]  # keys stay
    assert all("[REDACTED:" in x for x in json.loads(odd.raw_json)["note"][SECRETS[3]])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(path.read_text())
    capture.stream(spark, str(tmp_path / "in"), transcripts.claude, str(tmp_path / "two"), str(tmp_path / "check"), exact={"known-secret": SECRETS[:3]})
    assert {r.id for r in spark.read.parquet(str(tmp_path / "two")).collect()} == {said.id, odd.id}


def test_unknown_lines_are_read_again(spark, tmp_path):
    """A line that a reader did not know is kept, and becomes what a later reader makes of it."""
    path, where = tmp_path / "s.jsonl", str(tmp_path / "ledger")
    path.write_text(say(0, "hi") + "\n" + say(1, "new kind", role="utterance") + "\n" + json.dumps({"type": "odd", "sessionId": "s"}) + "\n")
    capture.catch_up(transcripts.lines(spark, str(path)), transcripts.claude, where, str(tmp_path / "marks"))
    events = spark.read.parquet(where).drop("part")
    assert {r.type for r in capture.unknown(events).collect()} == {"utterance", "odd"}
    later = lambda lines: transcripts.claude(lines.withColumn("value", F.replace("value", F.lit('"utterance"'), F.lit('"assistant"'))))
    made, notes = drift.renormalize(events, capture.again(later))
    (new,), (note,) = made.collect(), notes.collect()
    assert (new.kind, new.conversation.id, new.conversation.seq, new.actor.type) == ("conversation_turn", "claude-code:s", 1, "agent")
    assert note.links[0].rel == "supersedes" and drift.renormalize(events.unionByName(made).unionByName(notes), capture.again(later))[0].count() == 0
