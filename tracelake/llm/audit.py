"""Operator 12: how text filters interact, from a histogram of their failures.

Five filters, A to E, judge each text (null: empty; words are maximal runs of other
characters than space and ``\\t..\\r``):

    A  fewer than 50 words               C  more than 5 % of its characters are A to Z
    B  under 65 % distinct words         D  it holds one of # $ % & * |
    E  a row with a smaller doc_id has the same text

1. ``masks`` gives each row a mask with a bit a failed filter; A to D are expressions over
   the text alone.
2. For E, rows are first counted by id, text (its SHA-256) and part; the smallest doc_id of
   each text comes from a groupBy over these, which is partial before it is shuffled, so a
   text with any number of copies is a few rows a task by then.
3. What is left are cells: part, mask, and how many rows with which labels.
4. ``orders`` follows all 120 orders of the filters through the 32 cells of each part.

A null doc_id has no place in the order of ids: such rows fail E never, and make no other
fail it.  Rows that repeat an id count each, and fail E alike.  A null part is the empty
one.  Labels of one id count as 1 where any of them is; other columns are not read, so
their names do not matter.  An empty table has no parts and no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.textkit import partitions

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"


def masked(rows: DataFrame) -> DataFrame:
    """The rows with a column mask in place of text (not null): bits of A (1), B (2), C (4) and D (8)."""
    names = [c for c in rows.columns if c != "text"]
    words = rows.withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    found = words.select(*names, "text", F.size("_words").cast("long").alias("_n"), F.size(F.array_distinct("_words")).cast("long").alias("_kinds"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    fails = [F.col("_n") < 50, 100 * F.col("_kinds") < 65 * F.col("_n"), 100 * capitals > 5 * F.char_length("text").cast("long"), F.col("text").rlike(r"[#$%&*|]")]
    return found.select(*names, sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of a part fail just the filters of a mask, and how many of them carry which label."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    seen = masked(rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    seen = seen.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null ids meet no label, so they are spread by their text
    pad = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(max(2, partitions(docs.sparkSession)))) + 1).otherwise(0)
    seen = seen.withColumn("pad", pad).join(known.withColumn("pad", F.lit(0).cast("long")), ["doc_id", "pad"], "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    seen = seen.select("doc_id", "part", "digest", "mask", "n", *flags)
    # of each text the rows of a part and label, how many have no id, and how many the smallest id
    groups = seen.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    )
    # a text has as many of these rows as parts and labels by now, so its smallest id is a matter of a few rows
    groups = groups.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    spared = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), spared.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - spared).alias("n")))
    split = groups.select("part", "good", "toxic", F.explode(both).alias("x")).where(F.col("x.n") > 0)
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def orders(cells: DataFrame) -> DataFrame:
    """What each step of each of the 120 orders does to each part, from its at most 32 cells.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    """
    steps = [("".join(o), i + 1, 1 << FILTERS.index(o[i]), sum(1 << FILTERS.index(x) for x in o[:i])) for o in itertools.permutations(FILTERS) for i in range(5)]
    plan = F.lit([x[0] for x in steps]), F.lit([x[1] for x in steps]), F.lit([x[2] for x in steps]), F.lit([x[3] for x in steps])
    plan = F.arrays_zip(*(x.alias(n) for x, n in zip(plan, ("filter_order", "step", "bit", "before"))))
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = held.select("part", "cells", F.explode(plan).alias("s")).select("part", "cells", "s.*")

    def total(field: str, where) -> Column:
        return F.aggregate(F.filter("cells", lambda c: where(c["mask"])), F.lit(0).cast("long"), lambda s, c: s + c[field])

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    reached = lambda m: m.bitwiseAND(before) == 0
    lost = lambda m: fails(m) & reached(m)
    # in how many of the 120 orders a filter comes first among those that a row fails
    share = F.aggregate(F.filter("cells", lambda c: fails(c["mask"])), F.lit(0).cast("long"), lambda s, c: s + c["n"] * F.element_at(F.lit([120, 60, 40, 30, 24]), F.bit_count(c["mask"])))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total("n", lost).alias("removed"), total("n", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"), total("good", lost).alias("good_lost"), total("toxic", lost).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The interactions of the five filters within each part: 600 rows a part."""
    return orders(cells(docs, labels, part))
