"""Operator 1: a compression classifier scores quality.

Two Zstandard dictionaries are trained, one on labelled good text and one on bad.
A text is cut into blocks of ``BLOCK`` bytes, so that a dictionary tells on all of
a long text, and each block is compressed with both.  The normalised difference
``(bad - good) / (bad + good)`` of the summed sizes is positive where the good
dictionary serves better.  The same difference is also normalised by the text's raw
size, ``(bad - good) / bytes``: what a dictionary saves weighs less where the text
repeats itself.  A logistic calibration of both, linear between the quartiles of labelled
texts that neither dictionary has seen, turns them into a probability; its constant fits
the share of label 1 among all usable labels, so that scores are shares of label 1.

Null and empty texts have differences of 0 and get the
calibration's value there.  Only the text enters a score; equal texts score
alike.  With too few labels for both dictionaries every score is the share of
label 1 among the usable labels (0.5 if there are none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from tracelake.llm import labelled
from tracelake.llm.textkit import share, texts

BLOCK, LEVEL, DICT_BYTES = 4096, 3, 112640
#: Labelled documents of each class that the fit may use; half make the
#: dictionaries, half the calibration.
PER_CLASS = 2400
#: Blocks of a class that make its dictionary, spread evenly over its texts' blocks:
#: the parameter most_blocks of the fit, as per_class is (10 MB of text at most).
MOST_BLOCKS = 2500


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Calibration:
    """Terms of a logistic calibration from rows of the two differences: constant, each difference with a bend at its quartiles, product."""

    def __init__(self, x: np.ndarray):
        self.bends, self.scale = np.quantile(x, [0.25, 0.5, 0.75], axis=0), x.std(axis=0) + 1e-9

    def terms(self, x: np.ndarray) -> np.ndarray:
        z, bends = x / self.scale, self.bends / self.scale
        return np.concatenate([np.ones((len(x), 1)), z, *(np.maximum(0, z - b) for b in bends), z[:, :1] * z[:, 1:]], axis=1)


class Scorer:
    """Both dictionaries and the calibration's weights; what is shipped to executors."""

    def __init__(self, good: bytes, bad: bytes, constant: float = 0.5):
        self.good, self.bad, self.constant = good, bad, constant
        self.calibration, self.weights = None, None
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def measure(self, data: bytes) -> tuple[float, float]:
        """The difference of the compressed sizes over their sum, and over the raw size."""
        if self._pair is None:
            made = [zstandard.ZstdCompressionDict(x) for x in (self.good, self.bad)]
            for x in made:
                x.precompute_compress(level=LEVEL)
            self._pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=x, write_content_size=False, write_dict_id=False) for x in made]
        if not data:
            return 0.0, 0.0
        parts = blocks(data)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self._pair)
        return (bad - good) / (bad + good), (bad - good) / len(data)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.constant)
        rows = np.array([self.measure(t) for t in texts(column)]).reshape(-1, 2)
        return labelled.sigmoid(self.calibration.terms(rows) @ self.weights) if len(rows) else np.zeros(0)


def _dictionary(texts_: list[bytes], most_blocks: int) -> bytes | None:
    every = [b for t in texts_ for b in blocks(t)]
    if len(every) > most_blocks:
        every = [every[int(i)] for i in np.linspace(0, len(every) - 1, most_blocks)]
    size = min(DICT_BYTES, max(1024, sum(map(len, every)) // 8))
    try:
        return zstandard.train_dictionary(size, every, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text
        return None


def fit(rows: list[tuple[int, bytes]], most_blocks: int = MOST_BLOCKS, rate: float | None = None) -> Scorer:
    """Fit on (label, text) pairs; every other text of a class goes to its dictionary.  rate is the share of label 1, if not that of the pairs."""
    by = {y: [t for label, t in rows if label == y] for y in (0, 1)}
    rate = rate if rate is not None else len(by[1]) / len(rows) if rows else 0.5
    good, bad = _dictionary(by[1][::2], most_blocks), _dictionary(by[0][::2], most_blocks)
    rest = [(y, t) for y in (0, 1) for t in by[y][1::2]]
    if good is None or bad is None or len({y for y, _ in rest}) < 2:
        return Scorer(b"", b"", rate)
    scorer = Scorer(good, bad)
    x = np.array([scorer.measure(t) for _, t in rest])
    scorer.calibration = Calibration(x)
    scorer.weights = labelled.logistic(scorer.calibration.terms(x), np.array([y for y, _ in rest], dtype=float), ridge=0.1, share=rate)
    return scorer


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS, most_blocks: int = MOST_BLOCKS) -> Scorer:
    """Fit on a bounded sample of the labelled documents (see labelled.sample), in one task."""
    rows, rate = labelled.sample(docs, labels, label, per_class, usable), labelled.base_rate(labels, label, usable)
    return labelled.fitted(rows, lambda t: fit(list(zip(t["y"].to_pylist(), texts(t["text"]))), most_blocks, rate)) or fit([])


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id") -> DataFrame:
    """(key, score) of every document: one pass, no shuffle; the model is of fixed size."""
    shared = share(docs.sparkSession, scorer)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)), pa.float64())], [key, "score"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
