"""Logs replayed in micro-batches against logs replayed whole."""

import json
import random

from pyspark.sql import functions as F

from tracelake.sources import transcripts
from tracelake.streaming import wal


def log(rng, n):
    """Records of all kinds; ids repeat, rewinds may find nothing, snapshots reorder."""
    m = lambda i: {"id": f"m{i}", "type": "user", "content": f"t{rng.randrange(99)}"}
    out = [json.dumps({"sessionId": f"g{rng.randrange(9)}", "projectHash": "p", "startTime": "2026-01-01T00:00:00.000Z"})]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            out.append(json.dumps(m(rng.randrange(12))))
        elif kind < 0.75:
            out.append(json.dumps({"$rewindTo": f"m{rng.randrange(14)}"}))
        elif kind < 0.9:
            out.append(json.dumps({"$set": {"messages": [m(i) for i in rng.sample(range(12), rng.randrange(5))], "title": f"x{rng.randrange(5)}"}}))
        else:
            out.append(rng.choice(["no json", "[]", json.dumps({"$set": {}}), json.dumps({"sessionId": "late", "projectHash": "q", "messages": [m(3)]})]))
    return out


def test_stream_gives_what_whole_logs_give(spark, tmp_path):
    rng, schema = random.Random(4), "file string, seq long, value string"
    rows = [(f"f{f}", i, value, i // 11) for f in range(6) for i, value in enumerate(log(rng, 30))]  # three batches, in order
    for part in range(3):
        spark.createDataFrame([r[:3] for r in rows if r[3] == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changed = wal.capture(spark, *(str(tmp_path / x) for x in ("in", "out", "check")))
    whole = transcripts.gemini_log(spark.createDataFrame([r[:3] for r in rows], schema))
    got = wal.folded(changed)
    key = lambda r: (r.file, r.seq)
    assert sorted(map(tuple, got.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(got.collect(), key=key) and got.where(F.col("rewound")).count() > 0
