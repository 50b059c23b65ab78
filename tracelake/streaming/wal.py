"""Write-ahead logs as a stream: a log's state lives between micro-batches, so a batch reads its own records alone.

State of a log (keyed by file): the place of every message seen and its rank among the live
ones, the next place and rank, and the facts stated so far, as one value, which a batch reads and
writes once: each call of the state store is a round trip.  Texts of messages are not kept.
The stream gives changes (see CHANGES); ``folded`` makes of them what ``transcripts.gemini_log``
makes of whole logs, so its readers go on from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.sources.transcripts import Log

#: place and kind of what was stated; value and raw are null where only rewound has changed; turn counts a log's changes.
CHANGES = "file string, seq long, what string, value string, raw string, rewound boolean, named string, began string, turn long"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_CHANGE = Row(*[c.split(" ")[0] for c in CHANGES.split(", ")])


class Replay(StatefulProcessor):
    """Takes the records (seq, value) of a log as they come; within a batch by their seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("log", "count long, turn long, facts string, seen string")  # seen: {id: [place, rank]}, rank -1 where not live

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        count, turn, facts, seen = self.state.get() or (0, 0, "{}", "{}")
        before = json.loads(seen)
        live = sorted((x[1], i) for i, x in before.items() if x[1] >= 0)
        log = Log({i: x[0] for i, x in before.items()}, [i for _, i in live], count)
        log.facts = json.loads(facts)
        stated: dict[int, tuple] = {}
        text = lambda x: json.dumps(x, ensure_ascii=False)
        for value in [r.value for r in sorted(rows, key=lambda r: (r.seq is None, r.seq or 0))]:
            for seq, kind, fields, record in log.take(value):
                stated[seq] = (kind, text(fields), text(record))
        after = {i: (log.place[i], rank) for rank, i in enumerate(log.live)}
        after |= {i: (x, -1) for i, x in log.place.items() if i not in after}
        out, gone = [], {x[0]: x[1] < 0 for x in after.values()}
        named, began = (x if isinstance(x := log.facts.get(k), str) and x else None for k in ("sessionId", "startTime"))
        flagged = {x[0] for i, x in after.items() if i in before and (before[i][1] < 0) != (x[1] < 0)}
        for seq in sorted(stated.keys() | flagged):
            out.append((key[0], seq, *stated.get(seq, ("message", None, None)), gone.get(seq, False), named, began, turn))
            turn += 1
        self.state.update((log.count, turn, json.dumps(log.facts), json.dumps(after)))
        for x in out:
            yield _CHANGE(*x)

    def close(self) -> None:
        pass


def changes(records: DataFrame) -> DataFrame:
    """CHANGES of a stream of records (file, seq, value); the session's state store must be STATE_STORE's."""
    return records.groupBy("file").transformWithState(Replay(), CHANGES, "Update", "None")


def folded(changed: DataFrame) -> DataFrame:
    """(file, seq, what, value, raw, rewound, named, began) from changes: the last of each place, with a log's last facts."""
    order = F.col("turn")
    last = changed.groupBy("file", "seq").agg(
        F.max_by("what", order).alias("what"), F.max_by("value", F.when(F.col("value").isNotNull(), order)).alias("value"), F.max_by("raw", F.when(F.col("raw").isNotNull(), order)).alias("raw"), F.max_by("rewound", order).alias("rewound")
    )
    facts = changed.groupBy("file").agg(F.max_by("named", order).alias("named"), F.max_by("began", order).alias("began"))
    return last.join(facts, "file").select("file", "seq", "what", "value", "raw", "rewound", "named", "began")


def capture(spark: SparkSession, folder: str, out: str, checkpoint: str) -> DataFrame:
    """Take the records (Parquet of file, seq, value) of a folder that its checkpoint has not seen, and stop; all changes so far."""
    held = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        made = changes(spark.readStream.schema("file string, seq long, value string").parquet(folder))
        sink = made.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(out))
        sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], held)
    return spark.read.schema(CHANGES).parquet(out)
