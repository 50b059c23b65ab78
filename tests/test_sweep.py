"""Lines by byte address, and sweeps that open only files that have grown."""

import gzip
import json
import os
import random


from tracelake.sources import addressed, transcripts
from tracelake.streaming import capture


def say(i, session="s"):
    return json.dumps({"type": "user", "sessionId": session, "timestamp": f"2026-01-01T00:00:{i % 60:02d}.000Z", "message": {"role": "user", "content": f"m{i} " + "x" * (i * 7 % 50)}})


def plain(data: bytes):
    """(seq, value, begin, end) of each line."""
    at, out = 3 * data.startswith(b"\xef\xbb\xbf"), []
    parts = data[at:].split(b"\n")
    for i, x in enumerate(parts[:-1] if parts[-1] == b"" else parts):
        out.append((i, x.decode(), at, min(at + len(x) + 1, len(data))))
        at += len(x) + 1
    return out


def test_addresses(spark, tmp_path):
    rng = random.Random(2)
    texts = {
        "a": "", "b": "x", "c": "x\n", "d": "\n\n\n", "e": "é\r\n\n日本 \n" * 50, "f": "﻿one\ntwo\n", "g": "﻿one\ntwo", "h": "y" * 5000 + "\n" + "z" * 3000,
        "i": "".join("w" * rng.randint(0, 90) + "\n" for _ in range(2000)), "j": "".join("w" * rng.randint(0, 9) + "\n" for _ in range(3000)) + "torn",
    }
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "7001", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = addressed.lines(spark, str(tmp_path)).collect()
            for name, t in texts.items():
                mine = sorted((r.seq, r.value, r.begin, r.end) for r in got if r.file.endswith("/" + name))
                assert mine == plain(t.encode()), (size, name)
                assert all(r.size == len(t.encode()) and r.closed == t.endswith("\n") for r in got if r.file.endswith("/" + name))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "k.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    assert sorted((r.seq, r.begin, r.end) for r in addressed.lines(spark, str(tmp_path / "z")).collect()) == [(0, 0, 4), (1, 4, 8)]


def test_torn_line_is_read_once_it_is_whole(spark, tmp_path):
    """A cursor stops where a torn line begins, so one more byte makes its file grow."""
    folder, where, marks, aside = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "marks"), str(tmp_path / "aside")
    folder.mkdir()
    path = folder / "s.jsonl"
    run = lambda **more: [tuple(r)[1:] for r in capture.sweep(spark, str(folder), transcripts.claude, where, marks, aside, **more).collect()]
    whole = say(0) + "\n\n" + say(1)
    path.write_text(whole[:-1])
    assert run() == [] and run(adopt=True) == [(len(whole) - 1, "read", None)]
    (mark,) = capture.cursors(spark, marks).collect()
    assert (mark["count"], mark.size) == (2, len(say(0)) + 2)
    path.write_text(whole)
    assert run() == [(len(whole), "read", None)]
    assert spark.read.parquet(where).count() == 2
    (mark,) = capture.cursors(spark, marks).collect()
    assert mark.size == len(whole) and run() == []


def test_sweep_opens_what_has_grown(spark, tmp_path):
    folder, where, marks, aside = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "marks"), str(tmp_path / "aside")
    folder.mkdir()
    opened = []

    def read(spark, *paths):
        opened.append(sorted(os.path.basename(p) for p in paths))
        return transcripts.lines(spark, *paths)

    run = lambda: {os.path.basename(r.file): r.state for r in capture.sweep(spark, str(folder), transcripts.claude, where, marks, aside, adopt=True, read=read).collect()}
    for i in range(3):
        (folder / f"f{i}.jsonl").write_text(say(i, f"s{i}") + "\n")
    assert run() == {f"f{i}.jsonl": "read" for i in range(3)}
    with open(folder / "f1.jsonl", "a") as f:
        f.write(say(5, "s1") + "\n")
    (folder / "bad.jsonl.gz").write_text("no archive")
    opened.clear()
    assert run() == {"f1.jsonl": "read", "bad.jsonl.gz": "quarantined"}
    assert {x for names in opened for x in names} == {"f1.jsonl", "bad.jsonl.gz"}
    assert spark.read.parquet(where).count() == 4
    (held,) = spark.read.parquet(aside).collect()
    assert held.file.endswith("bad.jsonl.gz") and held.error
    opened.clear()
    assert run() == {} and opened == []
    (folder / "bad.jsonl.gz").write_bytes(gzip.compress((say(7, "s9") + "\n").encode()))
    assert run() == {"bad.jsonl.gz": "read"}


def test_nothing_stays_behind(spark, tmp_path):
    """What captures write on their way is gone when they end."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(say(1) + "\n")
    args = str(tmp_path / "in"), transcripts.claude, str(tmp_path / "ledger")
    capture.sweep(spark, *args, str(tmp_path / "marks"), str(tmp_path / "aside"), adopt=True)
    capture.stream(spark, *args, str(tmp_path / "check"))
    assert set(os.listdir(root)) == before
