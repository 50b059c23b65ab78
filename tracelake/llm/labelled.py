"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.textkit import settle

#: Bytes of text of each class that a fit may use.
SAMPLE_BYTES = 48 << 20


def remainder(key: str, divisor: int) -> Column:
    """crc32 of an integer key written as text, modulo the divisor; null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def _known(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(doc_id, y) of the usable labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def base_rate(labels: DataFrame, label: str, usable: Column) -> float:
    """The share of label 1 among all usable labels, whatever sample is fitted on; 0.5 without any."""
    rate = _known(labels, label, usable).agg(F.avg("y")).first()[0]
    return 0.5 if rate is None else rate


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column, seed: int = 7, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, y, text) of at most per_class documents and most_bytes of text of each class 0 and 1.

    The choice follows a hash of the key, so reruns agree, and holds at every
    input size: it first cuts the labels to that many keys a class, so that only
    a bounded list of keys meets the documents, each where it lies.  A key with both
    labels counts as 1; null keys and labels, keys without a document and unusable
    ones are left out; of rows that share a key one stays, by a hash of its text.  A
    text of more than a 16th of most_bytes (3 MB) teaches nothing: it is left out of the
    fit, and scored like any other.
    """
    known = _known(labels, label, usable)
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    keys = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    keys = keys[0].unionByName(keys[1])  # at most 2 * per_class rows
    text = F.coalesce("text", F.lit(""))
    met = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))
    met = met.where(F.col("bytes") <= most_bytes // 16).join(F.broadcast(keys), "doc_id")
    met = settle(met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "bytes")).alias("one")).select("doc_id", "y", "one.text", "one.bytes"), "labelled")
    run = F.sum("bytes").over(Window.partitionBy("y").orderBy(*order))  # over the few numbers of per_class rows
    kept = met.select("doc_id", "y", run.alias("run")).where(F.col("run") <= most_bytes).select("doc_id")
    return met.drop("bytes").join(F.broadcast(kept), "doc_id")


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]):
    """What fit makes of a bounded table, by doc_id: one task fits, so that the driver gets the model alone."""

    def run(batches):
        batches = list(batches)
        if batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(batches).sort_by("doc_id")))], pa.binary())], ["model"])

    made = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else None


def sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def logistic(features, y, ridge: float = 1.0, steps: int = 50, share: float = 0.5):
    """Weights of a ridge logistic regression by Newton steps; class 1 weighs that share of all, however many rows it has."""
    import numpy as np

    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(features.shape[1])
    for _ in range(steps):
        p = sigmoid(features @ w)
        hess = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, features.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def predictions(scored: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
