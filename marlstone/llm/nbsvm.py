"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear SVM.

The hinge loss is minimised by dual coordinate descent over a bounded labelled sample; a logistic
curve fitted on a part of the sample that the descent doesn't see makes margins probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm import text
from marlstone.llm.labelled import append, calibrate, class_sizes, sample, sigmoid
from marlstone.llm.store import map_batches

BITS = 20
SMOOTH, PENALTY, EPOCHS = 1.0, 0.1, 12
#: Every so many-th row of the sample calibrates and isn't descended on.
CALIBRATION_STEP = 4

#: Classes of bytes in a word's shape: lower case and non-ASCII, upper case, digit; any other byte is itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def _shapes(words: pa.Array) -> pa.Array:
    """Words with bytes made classes and runs of a class made one."""
    data, at = text.raw(words)
    shape = _SHAPE[data]
    new = np.ones(len(shape), dtype=bool)
    new[1:] = shape[1:] != shape[:-1]
    new[at[:-1][at[:-1] < len(shape)]] = True
    ends = np.zeros(len(shape) + 1, dtype=np.int64)
    np.cumsum(new, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends[at]), pa.py_buffer(shape[new])])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-gram indicators of all texts and their offsets by text.

    n-grams: words and word pairs (A-Z lower-cased), and one to three shapes of words, where a word
    equal to the one before has a shape of its own.
    """
    tokens, at = text.words(texts, lower=False)
    ids, distinct = text.coded(tokens)
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    row = text.row_of(at)
    low = pa.Array.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(np.ascontiguousarray(text.raw(distinct)[1])), pa.py_buffer(text._LOWER[text.raw(distinct)[0]])])
    word = text.hashes(low, 1)[ids]
    shape = text.hashes(_shapes(distinct), 2)[ids]
    again = np.append(False, (word[1:] == word[:-1]) & (row[1:] == row[:-1]))
    shape = np.where(again, np.uint64(0x5DEECE66D), shape)
    k = np.uint64(0x9E3779B97F4A7C15)
    pair, triple = row[1:] == row[:-1], row[2:] == row[:-2]
    grams = [(word, row), (text.mix(word[:-1] * k + word[1:])[pair], row[1:][pair]), (text.mix(shape), row), (text.mix(shape[:-1] * k + shape[1:])[pair], row[1:][pair]), (text.mix((shape[:-2] * k + shape[1:-1]) * k + shape[2:])[triple], row[2:][triple])]
    keys = np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for h, r in grams]).astype(np.int64)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(len(at), dtype=np.int64) << BITS)


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.of_features(*features(texts))

    def of_features(self, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = np.maximum(np.diff(at), 1)
        return sigmoid(self.slope * text.rows_sum(self.weights[columns].astype(np.float64), at) / np.sqrt(size) + self.offset)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows_per_class: int = 6000) -> Model:
    """A model from labelled training rows (those whose crc32 fold isn't 0), rows_per_class of each class at most.

    With one class or none, every score is the share of class 1 among the labels, or a half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, "text"):
                columns, at = features(part.column("text"))
                packed = columns.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([packed[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), part.column("label").cast(pa.int64())], names=["features", "label"])

    table = map_batches(sample(docs, labels, target, rows_per_class), run, "features binary, label bigint").toArrow()
    own = sorted(zip(table.column("label").to_pylist(), table.column("features").to_pylist()))
    del table
    sizes = class_sizes(labels, target)
    total = sum(sizes.values())
    share = (sizes.get(1, 0) + 0.5) / (total + 1)
    y = np.array([label for label, _ in own])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 1.0, float(np.log(share / (1 - share))))
    rows = [np.frombuffer(f, dtype=np.int32) for _, f in own]  # no copies: the sample is held once
    held = np.arange(len(y)) % CALIBRATION_STEP == 0
    train = np.flatnonzero(~held)
    counts = np.full((2, 1 << BITS), SMOOTH)
    for i in train:
        counts[y[i], rows[i]] += 1  # a row's indicators are distinct
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # Rows are divided by the root of their size, as long texts have many indicators.
    scale = np.array([1 / np.sqrt(max(len(r), 1)) for r in rows])
    n = np.bincount(y[train], minlength=2)
    upper = PENALTY * len(train) / (2 * n[y[train]])
    weights = ratio * descend([rows[i] for i in train], ratio, scale[train], np.where(y[train] == 1, 1.0, -1.0), upper)
    margins = np.array([weights[r].sum() for r in rows]) * scale
    prior = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    slope, offset = calibrate(margins[held], y[held], prior[held])
    return Model(weights.astype(np.float32), slope, offset)


def descend(rows: list[np.ndarray], ratio: np.ndarray, scale: np.ndarray, y: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Weights of the L2-regularised hinge loss by dual coordinate descent, examples in random order."""
    w, dual = np.zeros(len(ratio)), np.zeros(len(y))
    norm = np.array([max(float((ratio[r] ** 2).sum()) * s * s, 1e-12) for r, s in zip(rows, scale)])
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            own = rows[i]
            x = ratio[own] * scale[i]
            new = min(max(dual[i] - (y[i] * float(x @ w[own]) - 1.0) / norm[i], 0.0), upper[i])
            if new != dual[i]:
                w[own] += (new - dual[i]) * y[i] * x
                moved, dual[i] = max(moved, abs(new - dual[i])), new
        if moved < 1e-3:
            break
    return w


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score, P(label 1) of each text; null text is empty, and empty texts get the offset's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, text_col, {"score": T.DoubleType()}, lambda t: {"score": pa.array(shared.value.score(t))}, keep_text)
