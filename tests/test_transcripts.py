"""Transcript readers on small files of each format."""

import hashlib
import json

import pytest

from tracelake.sources import tables, transcripts


def write(folder, name, rows, end="\n"):
    path = folder / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)
    return str(path)


def read(df):
    out = {}
    for r in tables.finalize(df).collect():
        out.setdefault(r.conversation.seq, []).append(r)
    return out


def body(r):
    return json.loads(r.content_json)


T = "2026-01-01T00:00:0%d.000Z"


def test_claude(spark, tmp_path):
    rows = [
        {"type": "user", "sessionId": "s", "timestamp": T % 0, "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "sessionId": "s", "timestamp": T % 1, "message": {"role": "assistant", "model": "m-1", "content": [{"type": "thinking", "thinking": "t", "signature": "x"}, {"type": "tool_use", "id": "1", "name": "n", "input": {"b": 1, "a": 2}}]}},
        {"type": "assistant", "sessionId": "s", "timestamp": T % 2, "isSidechain": True, "agentId": "a7", "attributionAgent": "Explore", "message": {"role": "assistant", "content": "side"}},
        {"type": "mode", "sessionId": "s", "mode": "auto", "state_type": "clash"},
        {"type": "system", "sessionId": "s", "subtype": "turn_duration", "ms": 5},
        {"type": "system", "sessionId": "s", "content": "notice"},
        {"type": "attachment", "sessionId": "s", "attachment": {"type": "file"}},
        {"type": "queue-operation", "sessionId": "s", "operation": "enqueue", "content": "queued"},
        {"type": "file-history-snapshot", "sessionId": "s", "messageId": "m", "snapshot": {"trackedFileBackups": {"a.py": {"backupFileName": "abc@v1", "version": 1}, "b.py": {"backupFileName": None}}}},
        {"type": "new-thing", "sessionId": "s", "x": 1},
        "",
        "{torn",
    ]
    lines = transcripts.lines(spark, write(tmp_path, "s.jsonl", rows, ""))
    got = read(transcripts.claude(lines, human="me@x"))
    assert sorted(got) == list(range(10))
    one = {k: v[0] for k, v in got.items()}
    assert (one[0].kind, one[0].actor.type, one[0].actor.id, body(one[0])) == ("conversation_turn", "human", "me@x", {"role": "user", "blocks": [{"type": "text", "text": "hi"}]})
    assert body(one[1])["blocks"][0] == {"type": "thinking", "thinking": "t"} and one[1].producer.model == "m-1" and one[1].actor.id == "m-1"
    assert (one[2].conversation.id, one[2].conversation.parent, body(one[2])["agent"]) == ("claude-code:s#agent:a7", "claude-code:s", "Explore")
    assert (one[3].kind, body(one[3]), one[3].occurred_at) == ("session_state", {"mode": "auto", "state_type": "mode"}, T % 0)
    assert (one[4].kind, body(one[4])) == ("activity", {"activity_type": "system/turn_duration", "ms": 5, "subtype": "turn_duration"})
    assert (one[5].kind, one[5].actor.type, body(one[5])) == ("conversation_turn", "system", {"blocks": [{"type": "text", "text": "notice"}], "role": "system"})
    assert body(one[6])["injection_type"] == "attachment/file" and body(one[7])["blocks"] == [{"type": "text", "text": "queued"}]
    assert [f["path"] for f in body(one[8])["files"]] == ["a.py", "b.py"] and one[8].kind == "file_snapshot"
    assert (one[9].kind, body(one[9])) == ("unrecognized", {"unrecognized_type": "new-thing"})


def test_codex(spark, tmp_path):
    item = lambda n, **p: {"type": "response_item", "timestamp": T % n, "payload": p}
    rows = [
        item(0, type="message", role="user", content=[{"type": "input_text", "text": "q"}]),
        {"type": "session_meta", "timestamp": T % 1, "payload": {"id": "sid", "model": "m-1", "source": {"subagent": {}}, "parent_thread_id": "up"}},
        item(2, type="function_call", name="run", arguments="{}", call_id="c"),
        item(3, type="function_call_output", call_id="c", output="done"),
        {"type": "turn_context", "timestamp": T % 4, "payload": {"model": "m-2"}},
        item(5, type="reasoning", encrypted_content="xx", summary=[{"type": "summary_text", "text": "why"}]),
        item(6, type="agent_message", author="a", recipient="b", content=[{"type": "text", "text": "open"}, {"type": "encrypted_content", "data": "x"}]),
        {"type": "event_msg", "timestamp": T % 7, "payload": {"type": "user_message", "message": "q"}},
        {"type": "event_msg", "timestamp": T % 8, "payload": {"type": "task_started", "message": "go"}},
        item(9, type="web_search_call"),
    ]
    got = read(transcripts.codex(transcripts.lines(spark, write(tmp_path, "rollout-x.jsonl", rows))))
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert {r.conversation.id for v in got.values() for r in v} == {"codex:sid"} and got[0][0].conversation.parent == "codex:up"
    assert [got[i][0].producer.model for i in (0, 3, 5)] == ["m-1", "m-1", "m-2"]
    assert body(got[2][0])["blocks"] == [{"type": "tool_use", "name": "run", "input": "{}", "id": "c"}]
    assert body(got[3][0]) == {"role": "tool_result", "blocks": [{"type": "tool_result", "tool_use_id": "c", "content": "done"}]}
    assert sorted((r.kind, json.dumps(body(r), sort_keys=True)) for r in got[5])[1][0] == "reasoning" and len(got[5]) == 2
    (why,) = [r for r in got[5] if r.kind == "conversation_turn"]
    assert body(why) == {"role": "reasoning_summary", "blocks": [{"type": "text", "text": "why"}]} and why.raw_json is None and why.actor.type == "agent"
    open_, sealed = sorted(got[6], key=lambda r: r.kind)
    assert body(open_) == {"role": "agent_message", "author": "a", "recipient": "b", "blocks": [{"type": "text", "text": "open"}]} and (open_.actor.type, open_.actor.id) == ("agent", "a")
    assert json.loads(open_.raw_json)["payload"]["content"] == [{"type": "text", "text": "open"}, {"type": "encrypted_content"}] and '"x"' not in open_.raw_json
    assert (sealed.kind, body(sealed)) == ("reasoning", {"opaque": True})
    assert json.loads(sealed.raw_json)["payload"]["content"] == [{"type": "encrypted_content", "data": "x"}] and json.loads(sealed.raw_json)["payload"]["author"] == "a"
    assert (got[8][0].actor.type, body(got[8][0])) == ("agent", {"activity_type": "event_msg/task_started", "blocks": [{"type": "text", "text": "go"}]})
    assert body(got[9][0]) == {"unrecognized_type": "response_item/web_search_call"}


def test_codex_times_from_the_name(spark, tmp_path):
    rows = [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": []}}]
    for name, at in (("rollout-2026-02-03T04-05-06-abc.jsonl", "2026-02-03T04:05:06.000Z"), ("rollout-2026-99-03T04-05-06-abc.jsonl", transcripts.BASE_TIME), ("x.jsonl", transcripts.BASE_TIME)):
        (row,) = transcripts.codex(transcripts.lines(spark, write(tmp_path, name, rows))).collect()
        assert row.occurred_at == at


def test_snapshots_are_resolved(spark, tmp_path):
    """What the cache holds of the versions that snapshots name, each once, in their order."""
    saved = lambda *names: {f"/p/{i}": {"backupFileName": n, "version": i} for i, n in enumerate(names)}
    rows = [
        {"type": "file-history-snapshot", "messageId": "m", "snapshot": {"trackedFileBackups": saved("b@2", "a@1", "b@2", None, "gone@1")}},
        {"type": "file-history-delta", "trackingPath": "q", "backup": {"backupFileName": "gone@1"}},
        {"type": "user", "timestamp": T % 1, "message": {"role": "user", "content": "x"}},
    ]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "a@1").write_bytes(b"one")
    (tmp_path / "cache" / "b@2").write_bytes(b"xx")
    drafts = transcripts.claude(transcripts.lines(spark, write(tmp_path, "s.jsonl", rows)))
    got = {r.conversation.seq: r for r in transcripts.resolved(drafts, transcripts.backup_digests(spark, str(tmp_path / "cache"))).collect()}
    assert [(x.backup_file, x.bytes) for x in got[0].resolved] == [("b@2", 2), ("a@1", 3)] and got[0].resolved[1].sha256 == hashlib.sha256(b"one").hexdigest()
    assert got[1].resolved is None and got[2].resolved is None and len(got) == 3


def test_qwen(spark, tmp_path):
    base = lambda n, **x: {"sessionId": "q", "timestamp": T % n} | x
    rows = [
        base(0, type="user", message={"role": "user", "parts": [{"text": "hi"}]}),
        base(1, type="assistant", model="m", message={"role": "model", "parts": [{"text": "t", "thought": True}, {"functionCall": {"id": "1", "name": "f", "args": {"a": 1}}}]}),
        base(2, type="tool_result", message={"role": "user", "parts": [{"functionResponse": {"id": "1", "name": "f", "response": {"r": 2}}}]}),
        base(3, type="system", subtype="slash_command", content="/help"),
        base(4, type="system", subtype="attribution_snapshot", systemPayload={"snapshot": {"surface": "cli", "fileStates": {"a.py": {"chars": 3}}}}),
        base(5, type="system", subtype="custom_title", title="x"),
        base(6, type="assistant", message={"role": "model", "parts": [{"text": " "}]}),
        base(7, type="artifact"),
    ]
    got = {k: v[0] for k, v in read(transcripts.qwen(transcripts.lines(spark, write(tmp_path, "q.jsonl", rows)))).items()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7]
    assert body(got[1])["blocks"] == [{"type": "thinking", "text": "t"}, {"type": "tool_use", "id": "1", "name": "f", "input": {"a": 1}}]
    assert got[2].actor.type == "system" and body(got[2])["blocks"][0]["content"] == {"r": 2}
    assert got[3].actor.type == "human" and body(got[3])["activity_type"] == "system/slash_command"
    assert body(got[4]) == {"surface": "cli", "operation": "snapshot", "files": [{"chars": 3, "path": "a.py"}]}
    assert got[5].kind == "session_state" and got[7].kind == "unrecognized"


def test_replay():
    m = lambda i, text: json.dumps({"id": i, "type": "user", "content": text})
    made = transcripts.replay([json.dumps({"sessionId": "s", "projectHash": "p", "kind": "main"}), m("m1", "one"), json.dumps({"$set": {"lastUpdated": "x"}}), m("m1", "one!"), m("m2", "two")])
    assert [(s, x["id"], x["content"]) for s, x in made["messages"]] == [(1, "m1", "one!"), (3, "m2", "two")]
    assert [(s, k) for s, k, *_ in made["mutations"]] == [(0, "metadata"), (2, "metadata")] and made["rewound"] == []
    made = transcripts.replay([m("a", 1), m("b", 2), json.dumps({"$rewindTo": "b"}), m("c", 3), json.dumps({"$set": {"messages": [{"id": "c", "type": "user"}]}}), "bad", json.dumps({"$rewindTo": "none"})])
    assert [k for _, k, *_ in made["mutations"]] == ["rewind", "snapshot_drop", "rewind"] and made["rewound"] == ["a", "b", "c"]


def test_gemini(spark, tmp_path):
    rows = [
        {"sessionId": "g", "projectHash": "p", "startTime": T % 0},
        {"id": "1", "type": "user", "timestamp": T % 1, "content": "hi"},
        {"id": "2", "type": "gemini", "timestamp": T % 2, "model": "m", "content": "ok", "thoughts": [{"subject": "s", "description": "d"}], "toolCalls": [{"id": "c", "name": "f", "args": {}, "result": [1], "status": "success"}]},
        {"id": "3", "type": "gemini", "timestamp": T % 3, "content": "", "toolCalls": [{"id": "d", "name": "f", "status": "running"}]},
        {"id": "4", "type": "user", "timestamp": T % 4, "content": "<session_context>x"},
        {"$rewindTo": "4"},
    ]
    got = {k: v[0] for k, v in read(transcripts.gemini(transcripts.lines(spark, write(tmp_path, "g.jsonl", rows)))).items()}
    assert sorted(got) == [0, 1, 2, 4, 5]
    assert [b["type"] for b in body(got[2])["blocks"]] == ["thinking", "text", "tool_use", "tool_result"]
    assert (got[1].actor.type, got[4].actor.type, got[5].actor.type, got[5].occurred_at) == ("human", "system", "human", T % 0)
    assert got[0].kind == "session_state" and {r.conversation.id for r in got.values()} == {"gemini-cli:g"}


def test_opencode(spark, tmp_path):
    part = lambda **x: {"id": "p", "messageID": "m", "sessionID": "o"} | x
    doc = {
        "info": {"id": "o", "parentID": "up"},
        "messages": [
            {"info": {"role": "user", "time": {"created": 1767225600000}}, "parts": [part(type="text", text="hi")]},
            {"info": {"role": "assistant", "modelID": "m", "time": {"created": 1767225601000}}, "parts": [part(type="step-start"), part(type="tool", tool="t", callID="c", state={"status": "completed", "input": {"a": 1}, "output": "out", "time": {"start": 1767225602000}}), part(type="tool", tool="t", callID="d", state={"status": "running"}), part(type="text", text=" "), part(type="other")]},
        ],
    }
    path = tmp_path / "o.json"
    path.write_text(json.dumps(doc, indent=1))
    got = {k: v[0] for k, v in read(transcripts.opencode(spark, str(path))).items()}
    assert sorted(got) == [0, 1, 2, 5]
    assert [got[i].occurred_at for i in (0, 1, 2)] == [T % i for i in range(3)]
    assert body(got[2])["blocks"][1] == {"type": "tool_result", "tool_use_id": "c", "content": "out"}
    assert got[0].conversation.parent == "opencode:up" and got[5].kind == "unrecognized" and got[1].kind == "activity"


def test_opencode_numbers_from_ids(spark, tmp_path):
    texts = [{"id": f"prt_{t:012x}abc", "type": "text", "text": "x"} for t in (67580218395, 67580218396, 67580218400)]
    for name, parts, want in (("a", texts, [67580218395, 67580218396, 67580218400]), ("b", [*texts[:2], texts[0]], [0, 1, 2]), ("c", [*texts[:2], {"id": "odd", "type": "text", "text": "y"}], [0, 1, 2])):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({"info": {"id": "o"}, "messages": [{"info": {"role": "user"}, "parts": parts}]}))
        assert sorted(r.conversation.seq for r in transcripts.opencode(spark, str(path)).collect()) == want


def test_split_capture_is_the_same(spark, tmp_path):
    rows = [{"type": "user", "sessionId": "s", "timestamp": T % i, "message": {"role": "user", "content": f"m{i}"}} for i in range(9)]
    lines = transcripts.lines(spark, write(tmp_path, "s.jsonl", rows))
    ids = lambda df: sorted(r.id for r in tables.finalize(transcripts.claude(df)).collect())
    assert ids(lines) == sorted(ids(lines.where("seq < 4")) + ids(lines.where("seq >= 4")))
    assert pytest.approx(len(ids(lines))) == 9


def test_files_are_listed_newest_first(spark, tmp_path):
    import hashlib
    import os

    for i, name in enumerate(("a.jsonl", "b.jsonl", "c.jsonl")):
        (tmp_path / name).write_text("x" * (i + 1))
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    got = transcripts.files(spark, str(tmp_path), newest=2).collect()
    assert [(r.file[-7:], r.size) for r in got] == [("c.jsonl", 3), ("b.jsonl", 2)]
    digests = {r.backup_file: (r.sha256, r.bytes) for r in transcripts.backup_digests(spark, str(tmp_path)).collect()}
    assert digests["b.jsonl"] == (hashlib.sha256(b"xx").hexdigest(), 2)
    assert transcripts.project_folder("/home/me/a.b") == "-home-me-a-b"
