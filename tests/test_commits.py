"""Stored rewrites: redaction in place, draining, two writers, and writers that were lost."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import commits, ledger
from tracelake.sources import tables

SECRET = "hunter2xK9aa"


@pytest.fixture(scope="module")
def events(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"db_password: {SECRET}" if (c, t) == (1, 1) else f"text {c} {t}") for c in range(4) for t in range(3)]
    return tables.finalize(tables.chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).withColumn("anchor", F.col("conversation.id"))


def stored(spark, path):
    return spark.read.parquet(path)


def test_redacted_in_place(spark, events, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(events, path, rules=[])
    one = events.where(F.col("content_json").contains(SECRET)).select("id")
    none = events.limit(0)
    files = set(stored(spark, path).inputFiles())
    assert ledger.redact_in_place(spark, path, one, none, pattern=SECRET, reason="a test") == 1
    after = stored(spark, path)
    assert after.count() == 13 and after.where(F.col("content_json").contains(SECRET)).isEmpty()
    changed = after.join(one, "id").first()
    (note,) = after.where("kind = 'redaction'").collect()
    said = json.loads(note.content_json)
    assert changed.redactions[0].rule == "manual" and note.links[0] == ("redacts", changed.id) and note.anchor == "chat:1"
    assert (said["target"], said["mode"], said["reason"], said["fingerprints"]) == (changed.id, "pattern", "a test", [changed.redactions[0].fingerprint])
    touched = {r.part for r in after.where("anchor = 'chat:1'").select("part").distinct().collect()}
    assert all(f"part={p}/" in f for f in files ^ set(after.inputFiles()) for p in touched)  # other parts' files stay
    assert ledger.append(events, path, rules=[]) == {"appended": 0, "deduped": 12}  # the old id holds its place
    with pytest.raises(ValueError):  # what is shared is not known
        ledger.redact_in_place(spark, path, one, None, pattern="text")
    with pytest.raises(ValueError):
        ledger.redact_in_place(spark, path, one, one, pattern="text")
    assert ledger.redact_in_place(spark, path, spark.createDataFrame([("absent",)], "id string"), none) == 0


def test_pending_is_drained_by_an_append(spark, events, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(events.withColumn("anchor", F.lit(None).cast("string")), path, drain_to="a")
    assert stored(spark, path).where("anchor is null").count() == 12
    assert ledger.append(events.limit(1).withColumn("anchor", F.lit("b")), path, drain_to="a") == {"appended": 1, "deduped": 0}
    done = stored(spark, path)
    assert {(r.anchor, r.n) for r in done.groupBy("anchor").agg(F.count("*").alias("n")).collect()} == {("a", 12), ("b", 1)}
    assert not (tmp_path / "ledger" / "part=-1").exists()


def test_of_two_writers_one_reads_anew(spark, events, tmp_path):
    """A rewrite that another write has overtaken is made again on what that left."""
    path, calls = str(tmp_path / "ledger"), []
    ledger.append(events.where("conversation.seq = 0"), path)
    parts = ledger.parts_of(spark, "chat:1")

    def change(rows):
        calls.append(rows.count())
        if len(calls) == 1:  # meanwhile
            ledger.append(events.where("conversation.seq = 1"), path, rules=[])
        return rows.withColumn("media_type", F.lit("x"))

    commits.rewritten(spark, path, parts, change)
    assert len(calls) == 2 and calls[1] > calls[0]
    assert stored(spark, path).where("anchor = 'chat:1' and media_type = 'x'").count() == 2 and stored(spark, path).count() == 8
    log = commits.Commits(spark, path)
    with pytest.raises(commits.Conflict):
        log.claim(log.last(), {})


def test_lost_writers(spark, events, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    ledger.append(events, path, rules=[])
    log = commits.Commits(spark, path)
    log.claim(log.last() + 1, {"kind": "append"})  # and never came back
    monkeypatch.setattr(commits, "PATIENCE", 0.3)
    assert ledger.append(events, path, rules=[]) == {"appended": 0, "deduped": 12}
    # a rewrite that was lost after its claim is finished from its copy
    copy = str(tmp_path / "copy")
    part = ledger.parts_of(spark, "chat:2")
    stored(spark, path).where(F.col("part").isin(part)).withColumn("media_type", F.lit("late")).write.parquet(copy)
    log.claim(log.last() + 1, {"kind": "rewrite", "copy": copy, "emptied": []})
    assert log.ready() == log.last()
    assert stored(spark, path).where("media_type = 'late' and anchor = 'chat:2'").count() == 3 and stored(spark, path).count() == 12
