"""What large tables need: no task with all rows of a key, no work by file on the driver."""

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracelake import shared
from tracelake.functions import canonical, workers
from tracelake.operators import graph, ledger, reading
from tracelake.sources import transcripts
from tracelake.streaming import wal


def test_rows_of_few_anchors_stay_spread(spark, monkeypatch):
    """All rows hang on one anchor: where a scope is looked up, no task gets them all."""
    rows = spark.range(4000, numPartitions=8).select(F.lit("in").alias("anchor"), F.col("id").cast("string").alias("id"))
    rows = rows.unionByName(spark.createDataFrame([("out", "x"), (None, "y")], "anchor string, id string"))
    scope = spark.createDataFrame([("in",), ("in",), ("none",), (None,)], "anchor string")
    held = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent in (100_000, 0):
            monkeypatch.setattr(reading, "SENT", sent)
            got = reading.of_anchors(rows, scope).withColumn("task", F.spark_partition_id())
            tasks = {r.task: r.n for r in got.groupBy("task").agg(F.count("*").alias("n")).collect()}
            assert sum(tasks.values()) == 4000 and max(tasks.values()) < 3000
        assert reading.in_scope(rows, scope).count() == 4001
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held[1])
    assert "of_anchors" in ledger.gate.__code__.co_names


def test_many_files_are_named_by_their_folders(spark, tmp_path, monkeypatch):
    """Files by name without the driver renaming any, whatever the names; few tasks read them."""
    monkeypatch.setattr(shared, "place", lambda *x: 1 / 0)
    names = ["v%d" % i for i in range(200)] + ["007", "a+b", "a b%20c", "x@v1", "q=1:2"]
    shared.foldered_files(spark.createDataFrame([(n, "text " + n) for n in names], "name string, value string"), str(tmp_path / "cache"))
    found = transcripts.backup_digests(spark, str(tmp_path / "cache"), foldered=True)
    want = {n: hashlib.sha256(f"text {n}\n".encode()).hexdigest() for n in names}
    assert {r.backup_file: r.sha256 for r in found.collect()} == want and found.count() == len(names)
    assert len(found.inputFiles()) <= 16  # a task wrote each; at 4 MB a file there were some 50


def test_workers_take_slices_and_are_trimmed(monkeypatch):
    """Functions see short slices of a batch, in order, and the worker is trimmed at the end, also of a failed task."""
    trims = []
    monkeypatch.setattr(workers, "trim", lambda: trims.append(1))
    batch = pa.record_batch({"x": [f"{i:1000d}" for i in range(5000)], "y": list(range(5000))})
    seen = list(workers.trimmed(lambda bs: bs)([batch, batch.slice(0, 0), batch.slice(7, 3)]))
    assert max(b.nbytes for b in seen) <= 1.1 * workers.SLICE and len(trims) == 1
    assert [y for b in seen for y in b.column("y").to_pylist()] == [*range(5000), 7, 8, 9]
    try:
        list(workers.trimmed(lambda bs: (1 / 0 for _ in bs))([batch]))
    except ZeroDivisionError:
        pass
    assert len(trims) == 2
    texts = pa.array(['{"b":1,"a":"%s"}' % ("x" * 5000), None, "no"] * 600 + [])
    made = list(canonical._canonical(iter([texts, texts.slice(0, 0)])))
    assert [len(m) for m in made] == [1800, 0] and made[0][1].as_py() is None and made[0][1797].as_py().startswith('{"a":"xxx')


def test_a_batch_of_a_log_asks_the_state_store_twice():
    """However many messages a log has, a batch reads its state once and writes it once."""
    calls, held = [], [None]

    class Value:
        def get(self):
            calls.append("get")
            return held[0]

        def update(self, x):
            calls.append("update")
            held[0] = x

    log = wal.Replay()
    log.init(type("Handle", (), {"getValueState": lambda self, *x: Value()})())
    said = lambda i: json.dumps({"id": f"m{i}", "type": "user", "content": "x"})
    first = [tuple(r) for r in log.handleInputRows(("f",), iter([Row(seq=i, value=said(i)) for i in reversed(range(50))]), None)]
    assert [r[1] for r in first] == list(range(50)) and calls == ["get", "update"]
    more = [tuple(r) for r in log.handleInputRows(("f",), iter([Row(seq=51, value='{"$rewindTo":"m48"}'), Row(seq=50, value=said(50))]), None)]
    assert [(r[1], r[2], r[5]) for r in more] == [(48, "message", True), (49, "message", True), (50, "message", True), (51, "rewind", False)]
    assert calls == ["get", "update"] * 2
