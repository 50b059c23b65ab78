"""Operator 9: substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document.  Its minimiser is the
smallest hash of its runs of ``MER`` words, so equal windows have equal
minimisers wherever they stand.  Consecutive windows that share a minimiser make
a super-k-mer: one packed string of all their words, keyed by the minimiser.

1. One pass over the texts notes each super-k-mer as (minimiser, BLAKE2 digest of its
   words, document, place).  A minimiser that lies in one document only holds no
   repeated window, and its super-k-mers go no further.  Equal digests of 128 bits
   stand for equal words throughout.
2. Where all super-k-mers of a minimiser are one string, every window in it first
   starts in the smallest document: no words need to travel.
3. Else one copy of each different string travels to its minimiser's bucket, where
   its windows are sorted and compared word by word.
4. A bucket of more than ``CROWD`` windows (a passage quoted in very many
   documents) is dealt by window instead: windows are grouped by their words, and the
   smallest document of each is a minimum combined before the shuffle.
   A row's ranges do not grow with the rows that repeat it.
5. The windows found give each document the ranges of words to remove.

A window's words are removed where some document with a smaller doc_id has the
same window; all are judged on the input.  Null texts have no words.  Rows with a
null doc_id are kept whole and remove nothing; rows that share a doc_id remove
nothing from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.textkit import U64, Hasher, partitions, settle, shingle_hashes, texts, word_bounds

WINDOW, MER = 50, 8
#: Windows of a super-k-mer at most; a longer run goes on in the next one.
LONGEST = 256
#: Windows that a bucket may hold in one task, and that a task compares at once.
CROWD = 40_000


def joined(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words joined by one space, and where each starts and ends in that."""
    start, end = word_bounds(data)
    size = end - start
    ends = np.cumsum(size + 1) - 1
    return b" ".join(data[i:j] for i, j in zip(start.tolist(), end.tolist())), ends - size, ends


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width values in a row."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span :][:n])


def super_kmers(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, count of windows) of each super-k-mer of a text's word hashes."""
    if len(words) < window:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none, none
    least = sliding_least(shingle_hashes(words, MER), window - MER + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(least)]]))
    if counts.max() > LONGEST:
        parts = -(-counts // LONGEST)
        which = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, counts = starts[which] + nth * LONGEST, np.minimum(LONGEST, counts[which] - nth * LONGEST)
    return least[starts], starts, counts


def _noted(docs: DataFrame, window: int) -> DataFrame:
    """(mini, one, two, doc_id, h, start, n) of every super-k-mer; (one, two) is the digest of its words, n counts its windows."""

    def run(batches):
        for b in batches:
            for doc, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
                t, begin, end = joined(t)
                words = Hasher(t).of(begin, end) if len(begin) else np.zeros(0, dtype=U64)
                mini, start, n = super_kmers(words, window)
                if not len(mini):
                    continue
                ranges = zip(begin[start].tolist(), end[start + n + window - 2].tolist())
                digest = np.frombuffer(b"".join(hashlib.blake2b(t[i:j], digest_size=16).digest() for i, j in ranges), dtype=np.int64).reshape(-1, 2)
                cols = [mini.view(np.int64), digest[:, 0], digest[:, 1], np.full(len(n), doc), np.full(len(n), h), start, n]
                types = [pa.int64()] * 5 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, types)], ["mini", "one", "two", "doc_id", "h", "start", "n"])

    return docs.where("doc_id is not null").mapInArrow(run, "mini long, one long, two long, doc_id long, h long, start int, n int")


def _packed(wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted super-k-mers: (mini, one, two, hi, crowd, doc_id, words), one row each.

    Of rows that repeat one (doc_id, h) those that follow the first are passed over; the join
    brings them one behind the other, and where it does not, a string more does no harm.
    """

    def run(batches):
        last = None
        for b in batches:
            out = []
            for doc, h, t, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist()):
                if (doc, h) == last:
                    continue
                last = doc, h
                t, start, end = joined(t)
                for x in items:
                    packed = t[start[x["start"]] : end[x["start"] + x["n"] + window - 2]]
                    out.append((x["mini"], x["one"], x["two"], x["hi"], x["crowd"], doc, packed))
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    def _rows(out):
        cols = list(zip(*out)) if out else [()] * 7
        types = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["mini", "one", "two", "hi", "crowd", "doc_id", "words"])

    return wanted.mapInArrow(run, "mini long, one long, two long, hi long, crowd boolean, doc_id long, words binary")


_RUNS = "mini long, one long, two long, begin int, finish int, lo long"


def runs(rows: list[tuple], window: int) -> list[tuple]:
    """(mini, one, two, begin, finish, lo) for rows (mini, one, two, hi, doc, words) of whole buckets.

    Windows begin..finish-1 of the string first start in document lo, which is
    smaller than hi, the largest document that holds the string.
    """
    codes: dict[bytes, int] = {}
    buckets: dict[int, int] = {}
    coded = [np.array([codes.setdefault(w, len(codes)) for w in words.split(b" ")], dtype=np.int32) for *_, words in rows]
    counts = np.array([len(c) - window + 1 for c in coded])
    of = np.repeat(np.arange(len(rows)), counts)
    table = np.empty((len(of), window + 1), dtype=np.int32)
    table[:, 0] = np.array([buckets.setdefault(r[0], len(buckets)) for r in rows], dtype=np.int32)[of]
    at = 0
    for c, n in zip(coded, counts.tolist()):
        table[at : at + n, 1:] = np.lib.stride_tricks.sliding_window_view(c, window)
        at += n
    key = table.view(f"V{table.itemsize * (window + 1)}").ravel()
    _, same = np.unique(key, return_inverse=True)
    docs, hi = np.array([r[4] for r in rows], dtype=np.int64)[of], np.array([r[3] for r in rows], dtype=np.int64)[of]
    order = np.lexsort((docs, same))
    first = np.flatnonzero(np.diff(same[order], prepend=-1))
    lo = docs[order][first][same]
    hit = lo < hi
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    new = np.flatnonzero(hit & np.concatenate([[True], (of[1:] != of[:-1]) | (lo[1:] != lo[:-1]) | ~hit[:-1]]))
    last = np.flatnonzero(hit & np.concatenate([(of[1:] != of[:-1]) | (lo[1:] != lo[:-1]) | ~hit[1:], [True]]))
    return [(*rows[of[i]][:3], int(offset[i]), int(offset[j]) + 1, int(lo[i])) for i, j in zip(new, last)]


def _matched(strings: DataFrame, window: int) -> DataFrame:
    """runs() over buckets; rows arrive sorted by minimiser, and a bucket is at most a crowd."""

    def batch(out):
        cols = list(zip(*out)) if out else [()] * 6
        types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["mini", "one", "two", "begin", "finish", "lo"])

    def run(batches):
        held, size, key = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != key and size > CROWD:
                    yield batch(runs(held, window))
                    held, size = [], 0
                key = row[0]
                held.append(row)
                size += row[5].count(b" ") + 2 - window
        if held:
            yield batch(runs(held, window))

    return strings.select("mini", "one", "two", "hi", "doc_id", "words").mapInArrow(run, _RUNS)


def _windows(strings: DataFrame, window: int) -> DataFrame:
    """(mini, one, two, hi, doc_id, place, words) of each window of crowded buckets."""

    def run(batches):
        names = ["mini", "one", "two", "hi", "doc_id", "place", "words"]
        for b in batches:
            for *keys, words in zip(*(b.column(i).to_pylist() for i in range(6))):
                words, start, end = joined(words)
                n = len(start) - window + 1
                cols = [pa.array([x] * n, pa.int64()) for x in keys]
                cols += [pa.array(range(n), pa.int32()), pa.array([words[i:j] for i, j in zip(start[:n].tolist(), end[window - 1 :].tolist())], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return strings.select("mini", "one", "two", "hi", "doc_id", "words").mapInArrow(run, "mini long, one long, two long, hi long, doc_id long, place int, words binary")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, ranges) of documents (doc_id, h, text) with words to remove; a range (begin, finish) counts words."""
    spark = docs.sparkSession
    noted = settle(_noted(docs, window), "sub-noted")
    minis = noted.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("top"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("one", "two") for f in (F.min, F.max)])
    minis = settle(minis.where("lo < top").select("mini", "lo", ((F.col("one_min") != F.col("one_max")) | (F.col("two_min") != F.col("two_max"))).alias("many")), "sub-minis")
    # rows that repeat one (doc_id, text) count once from here on
    live = settle(noted.join(minis, "mini").dropDuplicates(["doc_id", "h", "start"]), "sub-live")
    end = F.col("start") + F.col("n") + window - 1
    alone = live.where("not many and doc_id > lo").select("doc_id", "h", F.col("start").alias("begin"), end.alias("finish"))
    several = live.where("many")
    strings = several.groupBy("mini", "one", "two").agg(F.min(F.struct("doc_id", "h", "start", "n")).alias("at"), F.max("doc_id").alias("hi"))
    strings = settle(strings, "sub-strings")
    crowds = strings.groupBy("mini").agg(F.sum("at.n").alias("windows")).where(F.col("windows") > CROWD).select("mini", F.lit(True).alias("crowd"))
    crowds = settle(crowds, "sub-crowds")  # a plain table again
    wanted = strings.join(crowds, "mini", "left").select("at.doc_id", "at.h", F.struct("mini", "one", "two", "at.start", "at.n", "hi", F.coalesce("crowd", F.lit(False)).alias("crowd")).alias("x"))
    wanted = wanted.groupBy("doc_id", "h").agg(F.collect_list("x").alias("items"))  # a document's own at most
    packed = settle(_packed(docs.join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text", "items"), window), "sub-packed")
    buckets = packed.where("not crowd").repartition(partitions(spark), "mini").sortWithinPartitions("mini")
    found = _matched(buckets, window)
    each = _windows(packed.where("crowd"), window)
    first = each.groupBy("words").agg(F.min("doc_id").alias("lo"), F.max("hi").alias("most")).where("lo < most").drop("most")
    first = settle(first, "sub-first")  # a plain table, so that the skew join can split a very common window
    crowded = each.join(first, "words").where("lo < hi").select("mini", "one", "two", "place", "lo")
    # places that follow one another with the same lo are one run
    gap = F.col("place") - F.row_number().over(Window.partitionBy("mini", "one", "two", "lo").orderBy("place"))
    crowded = crowded.withColumn("gap", gap).groupBy("mini", "one", "two", "lo", "gap").agg(F.min("place").alias("begin"), (F.max("place") + 1).alias("finish"))
    crowded = crowded.select("mini", "one", "two", "begin", "finish", "lo")
    found = found.unionByName(crowded)
    met = several.drop("lo").join(found, ["mini", "one", "two"]).where("lo < doc_id")
    met = met.select("doc_id", "h", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("finish") + window - 1).alias("finish"))
    return alone.unionByName(met).groupBy("doc_id", "h").agg(F.collect_list(F.struct("begin", "finish")).alias("ranges"))


def kept_words(data: bytes, ranges) -> tuple[int, int, bytes]:
    """(words, words removed, the kept ones joined by one space) of a text."""
    start, end = word_bounds(data)
    if not ranges:
        return len(start), 0, joined(data)[0]
    steps = np.zeros(len(start) + 1, dtype=np.int64)
    np.add.at(steps, [r["begin"] for r in ranges], 1)
    np.add.at(steps, [r["finish"] for r in ranges], -1)
    keep = np.cumsum(steps)[:-1] == 0
    return len(start), int((~keep).sum()), b" ".join(data[i:j] for i, j in zip(start[keep].tolist(), end[keep].tolist()))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept text if asked for, of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    joined = docs.join(repeats(docs, window), ["doc_id", "h"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def run(batches):
        for b in batches:
            rows = [kept_words(t, r) for t, r in zip(texts(b.column(1)), b.column(2).to_pylist())]
            cols = [b.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())]
            cols.append(pa.array([hashlib.sha256(x[2]).hexdigest() for x in rows], pa.string()))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x[2] for x in rows], pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, schema)
