"""Operator 8: document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its pairs of neighbouring words (its last word makes a pair
with nothing), each weighing as often as it occurs.  Sample k of a text is drawn
with numbers that depend on k and the term alone: r and c from Gamma(2, 1) and b
uniform in [0, 1).  With weight w the term gets

    t = floor(ln(w) / r + b),   ln(a) = ln(c) - r * (t - b) - r

and the sample is the (term, t) of the smallest a.  Two texts agree in a sample
with a probability equal to their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger ones.  A fingerprint holds 16 bits of
each of ``SAMPLES`` samples; ``likeness`` is the share that agrees.  The gamma numbers
are sums of two exponential ones, made from bits of hashes.

Terms are exploded and counted where their text lies: texts are dealt out by
document, and both the counts and the minima reuse that partitioning.  An edited
text shares its first part with the text as it was, and what both share is
exploded, counted and drawn once.

Null texts count as empty; an empty text has the empty fingerprint, whose likeness
is 1 to another empty one and 0 to the rest.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.textkit import partitions, settle

SAMPLES = 32
#: Pieces into which texts are dealt, in multiples of the session's shuffle
#: partitions: a piece's counts must fit in a task's memory.
PIECES = 6
SPACES, WORD_START = r"[\x20\x09-\x0D]+", r"^[^\x20\x09-\x0D]*"
_SCALE, _SHIFT = float(1 << 24), 64.0


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """Bits of a hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def pairs(found: Column, last: bool = True) -> Column:
    """The pairs (a, b) of neighbours in an array of words, and last the last word with nothing."""
    n = F.greatest(F.size(found) - 1, F.lit(0))
    after = F.slice(found, 2, n)
    if last:
        return F.when(F.size(found) > 0, F.arrays_zip(found.alias("a"), F.concat(after, F.array(F.lit(""))).alias("b")))
    return F.arrays_zip(F.slice(found, 1, n).alias("a"), after.alias("b"))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """ln(a) of a term for sample k, scaled to 31 bits, over 16 bits that name (term, t)."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    c = -F.ln(_uniform(two, 0, 24) * _uniform(two, 24, 24))
    b = _uniform(two, 48, 16)
    t = F.floor(log_weight / r + b)
    rank = ((F.greatest(F.ln(c) - r * (t - b + 1.0), F.lit(-_SHIFT)) + _SHIFT) * _SCALE).cast("long")
    name = one.bitwiseXOR(t.bitwiseAND(F.lit(0xFFFF)) * F.lit(0x9E37)).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(rank, 16).bitwiseOR(name)


def least_samples(weighted: DataFrame, keys: list[str], count: int = SAMPLES) -> DataFrame:
    """(keys, drawn) from (keys, term, weight): the smallest value of each sample; rows should be dealt out by keys."""
    logs = weighted.select(*keys, "term", F.ln(F.col("weight").cast("double")).alias("log_weight"))
    drawn = [F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(count)]
    least = logs.groupBy(*keys).agg(*drawn)
    return least.select(*keys, F.array(*[f"s{k}" for k in range(count)]).alias("drawn"))


def short(drawn: Column) -> Column:
    """A signature: the 16 bits of each sample that name its term."""
    return F.transform(drawn, lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint"))


def signatures(texts: DataFrame, keys: list[str], text: str = "text", count: int = SAMPLES) -> DataFrame:
    """(keys, signature) of each text that has words; texts should be dealt out by keys."""
    terms = texts.select(*keys, F.explode(pairs(words(F.coalesce(F.col(text), F.lit(""))))).alias("p"))
    terms = terms.groupBy(*keys, F.xxhash64("p.a", "p.b").alias("term")).agg(F.count("*").alias("weight"))
    return least_samples(terms, keys, count).select(*keys, short(F.col("drawn")).alias("signature"))


def render(signature: Column) -> Column:
    """A signature as a string of 4 hexadecimal digits a sample; empty for none."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + 0x8000)), 4, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two signatures agree; null signatures are those of empty texts."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / float(samples))


def following(keys: DataFrame) -> DataFrame:
    """keys (d, h, and more) with next_d, next_h: the row behind in order of d descending, then h; the last meets the first.

    Rows are dealt by ranges, each range looks ahead within itself, and its last
    row takes the first of the next range: one row a range meets in one task.
    """
    dealt = keys.repartitionByRange(partitions(keys.sparkSession), F.col("d").desc(), F.col("h"))
    dealt = settle(dealt.withColumn("range", F.spark_partition_id()), "fp-order")
    inside = Window.partitionBy("range").orderBy(F.col("d").desc(), "h")
    rows = dealt.withColumn("ahead", F.lead(F.struct("d", "h")).over(inside)).withColumn("place", F.row_number().over(inside))
    firsts = rows.where("place = 1").select("range", F.struct("d", "h").alias("first"))
    across = Window.orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(across), F.first("first").over(whole)).alias("after"))
    rows = rows.join(F.broadcast(firsts), "range")  # a row a range
    ahead = F.coalesce("ahead", "after")
    return rows.withColumns({"next_d": ahead["d"], "next_h": ahead["h"]}).drop("range", "ahead", "place", "after")


def edited(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: (d, h, doc_id, next_d, next_h, n_chars, copies, text, edited).

    Rows equal in doc_id and text are one document of so many copies; null ids come last.
    """
    pieces = PIECES * partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text, F.col("doc_id").isNull()).alias("h"), "doc_id", text.alias("text"))
    keys = base.groupBy("d", "h").agg(F.first("doc_id").alias("doc_id"), F.max(F.length("text").cast("long")).alias("n_chars"), F.count("*").alias("copies"))
    order = settle(following(keys), "fp-next")
    placed = base.select("d", "h", "text").repartition(pieces, "d", "h").dropDuplicates(["d", "h"])
    needs = order.select(F.col("next_d").alias("d"), F.col("next_h").alias("h"), F.struct("d", "h", "doc_id", "next_d", "next_h", "n_chars", "copies").alias("of"))
    needs = needs.repartition(pieces, "d", "h")
    heads = placed.join(needs, ["d", "h"]).select("of.*", F.expr("substring(text, 1, int(floor(of.n_chars / 3)))").alias("head"))
    heads = heads.repartition(pieces, "d", "h")
    new = F.expr("concat(substring(text, 1, int(n_chars - floor(n_chars / 3))), head)")
    return placed.join(heads, ["d", "h"]).withColumn("edited", new).drop("head")


def both_signatures(both: DataFrame, count: int = SAMPLES) -> DataFrame:
    """(d, h, own, new) from (d, h, text, edited, same): signatures of two texts whose first same code points agree."""
    share = F.expr("substring(text, 1, int(same))")
    whole = share.alias("share"), F.length(F.regexp_extract(F.reverse(share), WORD_START, 0)).alias("cut")
    cut = both.select("d", "h", "text", "edited", "same", *whole)
    base = words(F.expr("substring(share, 1, int(same - cut))"))
    rests = [words(F.expr(f"substring({c}, int(same - cut + 1))")) for c in ("text", "edited")]
    cut = cut.select("d", "h", base.alias("base"), rests[0].alias("own"), rests[1].alias("new"))
    last = F.when(F.size("base") > 0, F.slice("base", -1, 1)).otherwise(F.array().cast("array<string>"))
    parts = [pairs(F.col("base"), last=False), pairs(F.concat(last, "own")), pairs(F.concat(last, "new"))]
    parts = F.array(*[F.struct(F.lit(i).alias("part"), x.alias("pairs")) for i, x in enumerate(parts)])
    terms = cut.select("d", "h", F.explode(parts).alias("x")).select("d", "h", "x.part", F.explode("x.pairs").alias("p"))
    terms = terms.select("d", "h", "part", F.xxhash64("p.a", "p.b").alias("term")).groupBy("d", "h", "term")
    terms = terms.agg(F.sum(F.when(F.col("part") != 2, 1).otherwise(0)).alias("own"), F.sum(F.when(F.col("part") != 1, 1).otherwise(0)).alias("new"))
    one = lambda part, weight: F.struct(F.lit(part).alias("part"), F.col(weight).alias("weight"))
    two = F.when(F.col("own") == F.col("new"), F.array(one(0, "own"))).when(F.col("new") == 0, F.array(one(1, "own"))).when(F.col("own") == 0, F.array(one(2, "new")))
    rows = terms.select("d", "h", "term", F.explode(two.otherwise(F.array(one(1, "own"), one(2, "new")))).alias("x"))
    drawn = least_samples(rows.select("d", "h", "term", "x.part", "x.weight"), ["d", "h", "part"], count)
    drawn = drawn.groupBy("d", "h").agg(*[F.max(F.when(F.col("part") == i, F.col("drawn"))).alias(f"p{i}") for i in range(3)])
    joint = lambda i: F.coalesce(F.zip_with("p0", f"p{i}", lambda x, y: F.least(x, y)), "p0", f"p{i}")
    return drawn.select("d", "h", short(joint(1)).alias("own"), short(joint(2)).alias("new"))


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    Rows equal in doc_id and text stand in one place of the order, so they have the same
    next document, and give equal rows.  Only doc_id and text are read.
    """
    both = edited(docs)
    info = both.select("d", "h", "doc_id", "next_d", "next_h", "n_chars", "copies", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    pair = both_signatures(both.withColumn("same", F.expr("n_chars - floor(n_chars / 3)")), samples)
    made = settle(info.join(pair, ["d", "h"], "left"), "fp-made")
    ahead = made.select(F.col("d").alias("next_d"), F.col("h").alias("next_h"), F.col("own").alias("ahead"))
    out = made.join(ahead, ["next_d", "next_h"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", render(F.col("own")).alias("fingerprint"), render(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), samples).alias("near_edited"), likeness(F.col("own"), F.col("ahead"), samples).alias("near_next"),
    )
