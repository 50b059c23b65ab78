"""Sieves lose no key and let few others pass; large graphs are walked without sending all their edges about."""

from pyspark.sql import functions as F

from tracelake.functions import sieves
from tracelake.operators import graph


def test_a_sieve_loses_no_key(spark, monkeypatch):
    name = F.concat(F.lit("k"), F.col("id")).alias("key")
    for n, most, least in ((3000, 1 << 27, 0), (3000, 32768, 50), (0, 1 << 27, 0)):
        monkeypatch.setattr(sieves, "MOST", most)
        passes = sieves.sieve(spark.range(n).select(name), n)
        rows = spark.range(20_000).select(F.col("id"), name)
        got = {r.id for r in rows.where(passes("key")).collect()}
        assert set(range(n)) <= got and least <= len(got) - n <= max(0.02 * n, 1000 * least)
    assert spark.range(9).withColumn("key", F.lit(None).cast("string")).where(passes("key")).count() == 0
    ints = sieves.sieve(spark.range(5, 7), 2)
    assert [r.k for r in spark.range(100).select(F.col("id").cast("int").alias("k")).where(ints("k")).collect()] == [5, 6]


def test_steps_send_only_the_edges_that_they_take(spark, monkeypatch):
    """With more nodes than are sent to all edges, a step's join gets the edges of these nodes, not all."""
    joined = []
    real = graph.sieve

    def watched(keys, n):
        passes = real(keys, n)

        def test(name):
            joined.append((n, edges.where(passes(name)).count() if name == "src" else None))
            return passes(name)

        return test

    monkeypatch.setattr(graph, "sieve", watched)
    monkeypatch.setattr(graph, "SMALL", 5)
    monkeypatch.setattr(graph, "SENT", 10)
    edges = spark.range(1, 20_000).select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"), F.lit(1).cast("long").alias("mask"))
    start = spark.range(16_000, 20_000, 200).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("bits"))
    want = {0}
    for k in range(16_000, 20_000, 200):
        while k:
            want.add(k)
            k //= 2
    assert {r.node for r in graph.reach(edges, start).collect()} == want
    assert joined and all(n <= taken <= n + 60 for n, taken in joined)


def test_mappings_without_what_is_in_view(spark, monkeypatch):
    """Above and below the rows that are sent to all: the same rows stay, those without a key too."""
    rows = spark.createDataFrame([(k, None if k == 3 else f"s{k % 7}") for k in range(50)], "k long, sha string")
    of = spark.createDataFrame([("s1",), ("s5",), ("s9",)], "sha string")
    for sent in (100, 0):
        monkeypatch.setattr(graph, "SENT", sent)
        left = graph._without(rows, of, 3, "sha")
        assert left.columns == ["k", "sha"] and {r.k for r in left.collect()} == {k for k in range(50) if k == 3 or k % 7 not in (1, 5)}
        assert {r.k for r in graph._meet(rows, of, 3, "sha").collect()} == {k for k in range(50) if k != 3 and k % 7 in (1, 5)}
