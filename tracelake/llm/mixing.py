"""Operator 2: mixing sources to target weights by pivotal dependent rounding.

``targets`` shares a budget of words among sources by weight, each source capped
at a multiple of its own words.  ``mix`` then gives each document of a source the
fractional number of copies target / source size.  Its whole part is taken as it
is; the fractions are rounded by the pivotal method on words: of two documents
with open fractions, words move from one to the other, in a random direction
whose odds keep both expectations, until one fraction is 0 or 1.  The words taken
so far plus those still open stay at the target throughout, so a source misses its
target by less than the words of the one document left at the end.

The reduction tree: documents of a source are dealt by a hash of their key into
nodes of about ``NODE``; each node settles all but one of its documents, the
ones left meet in nodes of the next level, until each source has one node, whose
last document is rounded to the nearer side.  A hot source is thus many nodes.
All draws are seeded by the source, the level and the node, and rows are sorted
inside a node, so reruns and lost executors give the same mix.

Null and empty texts have size 0 and are taken as 0 words; a null source is a
source of its own, last in order; repeated keys and equal rows are rows of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.textkit import partitions, settle

NODE = 2048
#: Bytes of source names and figures that are sent to all tasks; beyond them, sources meet documents in a shuffle.
SENT = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with place, from 0, by source in code point order, null last: ranges are sorted each for itself."""
    order = F.col("source").asc_nulls_last()
    dealt = settle(sizes.repartitionByRange(partitions(sizes.sparkSession), order).withColumn("range", F.spark_partition_id()), "mix-order")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    per = dealt.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.col("ahead")
    return dealt.join(F.broadcast(per), "range").withColumn("place", place).drop("range", "ahead")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat along the sources by code point, null last.  What a unit of weight
    gets is raised round by round: sources whose cap it would pass are capped, and what
    they leave is shared anew by weight among the others, until none is above.  A round
    is a sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = numbered(sizes.select("source", "source_size")).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    s = settle(s.select("source", "source_size", "weight", "most", (F.col("most") / F.col("weight")).alias("ratio")), "mix-weights")
    budget = float(share) * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = -1.0, None
    while True:
        open_ = F.col("ratio") > level
        got = s.agg(F.count_if(~open_).alias("n"), F.sum(F.when(~open_, F.col("most"))).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        if got["n"] == capped or not got["weight"]:
            break
        level, capped = (budget - (got["full"] or 0.0)) / got["weight"], got["n"]
    return s.select("source", "source_size", F.when(F.col("ratio") > level, F.col("weight") * level).otherwise(F.col("most")).alias("target"))


def pivot(sizes: np.ndarray, parts: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round fractions in turn, keeping sum(sizes * parts); returns them and the index of the one left open, or -1."""
    rng = np.random.default_rng(seed)
    out, left = parts.copy(), -1
    for i in range(len(out)):
        if out[i] <= 0.0 or out[i] >= 1.0:
            continue
        if left < 0:
            left = i
            continue
        a, b = sizes[left], sizes[i]
        p, q = out[left], out[i]
        up = min((1 - p) * a, q * b)  # words that can move from i to left
        down = min(p * a, (1 - q) * b)  # and the other way
        if rng.random() * (up + down) < down:
            moved, first = up, (1 - p) * a <= q * b
            out[left], out[i] = p + up / a, q - up / b
            ends = (1.0, 0.0)
        else:
            moved, first = -down, p * a <= (1 - q) * b
            out[left], out[i] = p - down / a, q + down / b
            ends = (0.0, 1.0)
        if first:  # the left one became whole
            out[left], left = ends[0], i
        else:
            out[i] = ends[1]
        if left == i and (out[i] <= 1e-12 or out[i] >= 1 - 1e-12):  # both at once
            out[i], left = round(out[i]), -1
        elif left >= 0 and (out[left] <= 1e-12 or out[left] >= 1 - 1e-12):
            out[left], left = round(out[left]), -1
    return out, left


def _level(open_: DataFrame, level: int, seed: int) -> DataFrame:
    """Settle all but one document in each node."""

    def run(key, table):
        table = table.sort_by([("size", "descending"), ("row", "ascending")])
        draw = zlib.crc32(f"{seed}|{level}|{key[1].as_py()}|{key[0].as_py()!r}".encode())
        parts, left = pivot(table["size"].to_numpy().astype(float), table["part"].to_numpy(), draw)
        settled = np.arange(len(parts)) != left
        return table.set_column(table.column_names.index("part"), "part", pa.array(parts)).append_column("settled", pa.array(settled))

    schema = T.StructType([*open_.schema.fields, T.StructField("settled", T.BooleanType())])
    return open_.groupBy("source", "node").applyInArrow(run, schema)


def copies(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 2024, node: int = NODE) -> DataFrame:
    """(doc_id, source, size, source_size, target, row, copies) of every document; row is a hash of all its columns."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # texts are read once; equal rows get a running number, so that any number of them is spread over the nodes
    alike = sized.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("alike"))
    stretch, most_alike = 4096, F.col("alike") - 1
    alike = alike.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(most_alike / stretch))))
    alike = alike.withColumn("nth", F.explode(F.sequence(F.col("_of") * stretch, F.least(most_alike, (F.col("_of") + 1) * stretch - 1))))
    sized = settle(alike.drop("alike", "_of"), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(per.select("source", "source_size"), share, cap, weights)
    per = settle(plan.alias("p").join(per.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))).select("p.*", "c.n"), "mix-sources")
    held = per.agg(F.max("n").alias("n"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64).alias("bytes")).first()
    most = held["n"] or 0
    if (held["bytes"] or 0) <= SENT:
        per = F.broadcast(per)
    rated = sized.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(copies, F.lit(float(cap)))
    rated = rated.withColumn("whole", F.floor(copies + 1e-12)).withColumn("part", F.greatest(copies - F.col("whole"), F.lit(0.0)))
    rated = rated.withColumn("part", F.when((F.col("part") < 1e-12) | (F.col("size") == 0), 0.0).otherwise(F.col("part")))
    nodes = F.ceil(F.col("n") / F.lit(float(node)))
    rated = rated.withColumn("node", F.pmod(F.xxhash64("row", "nth", F.lit(seed)), F.greatest(nodes, F.lit(1))))
    rated = rated.select("doc_id", "source", "size", "row", "source_size", "target", "whole", "part", "node")
    done, level, left = [rated.where("part = 0")], 0, -(-most // node)
    step = settle(_level(rated.where("part > 0"), level, seed), "mix-level")
    while True:
        done.append(step.where("settled").drop("settled"))
        rest = step.where("not settled").drop("settled")
        if left <= 1:
            done.append(rest.withColumn("part", F.round("part")))  # one document a source
            break
        level, left = level + 1, -(-left // node)
        rest = rest.withColumn("node", F.floor(F.col("node") / node) if left > 1 else F.lit(0).cast("long"))
        step = settle(_level(rest, level, seed), "mix-level")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", "row", (F.col("whole") + F.round("part")).cast("long").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every document; settings are those of copies."""
    taken = copies(docs.select("doc_id", "source", "text"), **settings).withColumn("taken", F.col("size") * F.col("copies"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def draw(docs: DataFrame, **settings) -> DataFrame:
    """Each document as often as the mix takes it, all its columns as they were; equal rows are taken as often as all of them together."""
    taken = copies(docs, **settings).groupBy("doc_id", "row").agg(F.sum("copies").alias("copies")).where("copies > 0")
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = one.withColumn("key", F.col("d.doc_id")).dropDuplicates(["key", "row"])
    met = one.join(taken, one["key"].eqNullSafe(taken["doc_id"]) & (one["row"] == taken["row"]))
    return met.select("d", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("d.*")
