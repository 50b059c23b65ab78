"""Screens of ids: none is lost, few are there by chance, and new batches read no part."""

from pyspark.sql import functions as F

from tracelake.operators import ledger, screens
from tracelake.sources import tables


def test_screens_know_their_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(screens, "MOST", 3)
    screen = screens.Screen(spark, str(tmp_path))
    name = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("ev1-"), F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("id"))
    assert screen.filters() == [] and screen.may_hold(name(0, 5)).count() == 0
    for i in range(4):
        screen.grow(name(i * 2000, (i + 1) * 2000), i + 1, name(0, i * 2000) if i else None)
    assert [n for n, _ in screen.filters()] == [4]  # all were put into one
    screen.grow(name(8000, 8001), 5, name(0, 8000))
    assert [n for n, _ in screen.filters()] == [4, 5]
    assert screen.may_hold(name(0, 8001)).count() == 8001
    assert screen.may_hold(name(10_000, 30_000)).count() < 60


def test_new_batches_read_no_part(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user", f"text {c} {t}") for c in range(30) for t in range(3)]
    events = tables.finalize(tables.chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).withColumn("anchor", F.col("conversation.id"))
    path, looked, real = str(tmp_path / "ledger"), [], ledger.parts_known
    monkeypatch.setattr(ledger, "parts_known", lambda *a: (looked.append(real(*a)), looked[-1])[1])
    at = lambda t: events.where(F.col("conversation.seq") == t)
    put = lambda batch, **more: ledger.append(batch, path, rules=[], **more)
    assert put(at(0)) == {"appended": 30, "deduped": 0} and looked == []  # small parts need no screen
    assert put(at(0), screen_from=0) == {"appended": 0, "deduped": 30}  # it is made of what is stored, too
    assert put(at(1), screen_from=0) == {"appended": 30, "deduped": 0} and len(looked[-1]) <= 1
    assert put(events) == {"appended": 30, "deduped": 60} and len(looked[-1]) > 5  # kept up from then on
    some = at(2).where("conversation.id = 'chat:3'").select("id")
    assert ledger.redact_in_place(spark, path, some, events.limit(0), pattern="text") == 1
    note = spark.read.parquet(path).where("kind = 'redaction'").select("id")
    assert screens.Screen(spark, path).may_hold(note).count() == 1
    assert put(events) == {"appended": 0, "deduped": 90}
