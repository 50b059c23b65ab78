"""Operator 7: a factorization machine over hashed terms scores toxicity.

Terms are a text's distinct words with ASCII letters lower-cased, and their first
4, 5 and 6 bytes (inflected forms share a stem), hashed into ``SPACE`` places.
Fitting keeps every place that at least ``LEAST_DOCS`` texts of the labelled sample have
(``least_docs`` of ``train``: a term of one or two texts tells them apart by chance), and learns

    logit = w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the known terms present in a text, so that pairs of terms (an insult with a
mention of a group) add what neither adds alone.  The weights of a term are held
to zero the more, the fewer standard errors (``SURE_Z`` at most, ``FAINT`` of that
at least) its document frequencies differ by between the classes: a weak term needs
more texts that ask for it, alone or in a pair.  The pair sum
is computed as half of |sum v|^2 - sum |v|^2.  Null and empty texts have no terms and score
sigmoid(w0).  Only the text enters a score; equal texts score alike.  With no
usable labels of both classes every score is the share of label 1 (0 if none).
Repeated rows give a row each, an empty table none; columns beside the key and the text
are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import labelled
from tracelake.llm.textkit import Hasher, settle, share, texts, trimmed, word_bounds

SPACE = 1 << 20
SURE_Z, FAINT = 6.0, 0.03
FACTORS, STEPS, RATE, DECAY = 8, 60, 0.05, 3e-3
#: Labelled documents of each class that the fit may use, and the documents of that
#: sample that a term must be in: in four folds inside the documents that may be learnt
#: from, at sf0.1, recall is 0.92 with 3 and 0.89 with 1, at a false rate of 0.005.
PER_CLASS, LEAST_DOCS = 4000, 3


def terms(data: bytes) -> np.ndarray:
    """The distinct hashed terms of a UTF-8 text."""
    data = data.lower()
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, dtype=np.int32)
    h = Hasher(data)
    every = [h.of(start, np.minimum(end, start + n)) for n in (4, 5, 6)] + [h.of(start, end)]
    return np.unique((np.concatenate(every) >> np.uint64(44)).astype(np.int32))


class Machine:
    """A fitted model of the terms at places (sorted); index maps a term's place to its row of weights, or -1."""

    def __init__(self, places, w0, w, v):
        self.places, self.w0, self.w, self.v = places, w0, w, v
        self.index = np.full(SPACE, -1, dtype=np.int32)
        self.index[places] = np.arange(len(places))

    def __reduce__(self):
        return Machine, (self.places, self.w0, self.w, self.v)

    def logit(self, found: np.ndarray) -> float:
        rows = self.index[found]
        rows = rows[rows >= 0]
        v = self.v[rows]
        total = v.sum(axis=0)
        return float(self.w0 + self.w[rows].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, data: bytes) -> float:
        return float(labelled.sigmoid(self.logit(terms(data))))


def fit(found: list[np.ndarray], y: np.ndarray, seed: int = 11, decay: float = DECAY, faint: float = FAINT, steps: int = STEPS) -> Machine:
    """Fit on the term lists of labelled texts, both classes weighing the same; Adam on all of them at once."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        share = n1 / max(1, n0 + n1)
        return Machine(np.zeros(0, dtype=np.int64), 40.0 * (2 * share - 1), np.zeros(1), np.zeros((1, FACTORS)))
    places = np.flatnonzero(np.bincount(np.concatenate(found), minlength=SPACE)) if sum(map(len, found)) else np.zeros(1, dtype=np.int64)
    index = np.full(SPACE, -1, dtype=np.int32)
    index[places] = np.arange(len(places))
    live = np.flatnonzero([len(x) > 0 for x in found])  # a sum of each run needs one term at least
    n, m = len(found), len(places)
    row = index[np.concatenate([found[i] for i in live])] if len(live) else np.zeros(0, dtype=np.int32)
    doc = np.repeat(live.astype(np.int32), [len(found[i]) for i in live])
    docs = np.flatnonzero(np.diff(doc, prepend=-1))  # where the terms of each text begin
    order = np.argsort(row, kind="stable")
    cols = np.flatnonzero(np.diff(row[order], prepend=-1))  # and the texts of each term
    doc = doc[order]
    del order
    one, every = np.bincount(row, (y[live] == 1).repeat(np.diff(docs, append=len(row))), m), np.bincount(row, minlength=m)
    p = every / n
    z = (one / n1 - (every - one) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    trust = np.clip(np.abs(z) / SURE_Z, faint, 1).astype(np.float32)
    del one, every, p, z
    # column 0 of the tables is w, the others are v; what enters the sum is weights times trust
    weights = np.random.default_rng(seed).normal(0, 0.01, (FACTORS + 1, m)).astype(np.float32)
    weights[0] = 0
    w0, grad, mean, square = 0.0, np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(weights)
    mean0 = square0 = 0.0
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    total = np.zeros((FACTORS + 1, n), dtype=np.float32)
    for step in range(1, steps + 1 if len(row) else 1):
        pair, own = np.zeros(n), np.zeros(m, dtype=np.float32)
        for f in range(FACTORS + 1):  # a factor at a time, so that memory holds a few numbers a term
            part = weights[f] * trust
            total[f, live] = np.add.reduceat(part[row], docs)
            if f:
                pair += total[f].astype(np.float64) ** 2
                own += part * part
        pair[live] -= np.add.reduceat(own[row], docs)
        g = balance * (labelled.sigmoid(w0 + total[0] + 0.5 * pair) - y)
        gr = g.astype(np.float32)
        each = np.add.reduceat(gr[doc], cols)
        for f in range(FACTORS + 1):
            asked = np.add.reduceat((gr * total[f])[doc], cols) - weights[f] * trust * each if f else each
            grad[f] = asked * trust + decay * weights[f]
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad * grad - square)
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        mean0 += 0.1 * (g.sum() - mean0)
        square0 += 0.001 * (g.sum() ** 2 - square0)
        w0 -= RATE * (mean0 / (1 - 0.9**step)) / (np.sqrt(square0 / (1 - 0.999**step)) + 1e-8)
    weights *= trust
    return Machine(places, float(w0), weights[0].copy(), weights[1:].T.copy())


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS, least_docs: int = LEAST_DOCS) -> Machine:
    """Fit on a bounded sample of the labelled documents (see labelled.sample).

    Texts become terms where they lie, Spark counts the sample's documents by term,
    and one task fits on the terms of least_docs of them or more; the driver gets the model alone.
    """

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t) for t in texts(b.column(2))], pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    picked = labelled.sample(docs, labels, label, per_class, usable).select("doc_id", "y", "text")
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, y int, terms array<int>"
    rows = settle(picked.mapInArrow(trimmed(hashed), schema), "tox-terms")
    seen = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    known = np.zeros(SPACE, dtype=bool)  # of fixed size, whatever the input's
    known[seen.select("term").toArrow()["term"].to_numpy()] = True
    known = np.packbits(known)

    def left(batches):
        have = np.unpackbits(known).astype(bool)
        for b in batches:
            lists = [x.values.to_numpy() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[have[x]] for x in lists], pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    def learn(table):
        return fit([x.values.to_numpy() for x in table["terms"]], np.array(table["y"], dtype=np.int64))

    model = labelled.fitted(rows.mapInArrow(trimmed(left), schema), learn)
    return model or fit([], np.zeros(0, dtype=np.int64))


def score(docs: DataFrame, model: Machine, key: str = "doc_id") -> DataFrame:
    """(key, score) of every document: one pass, no shuffle; the model is of fixed size."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in texts(b.column(1))], pa.float64())], [key, "score"])

    return docs.select(key, "text").mapInArrow(trimmed(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = share(docs.sparkSession, model)
    i = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in texts(b.column(i))], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
