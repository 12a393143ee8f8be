"""Bounded samples of labelled rows, folds, and logistic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import text
from marlstone.llm.store import map_batches

#: Labelled rows of each class that a classifier is fitted on at most.
ROWS_PER_CLASS = 6000


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in part 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, target: str, rows_per_class: int = ROWS_PER_CLASS, train: Callable[[str], Column] = lambda c: fold(c, 5) != 0, id_col: str = "doc_id", text_col: str = "text", classes: tuple = (0, 1)) -> DataFrame:
    """Columns text and label: labelled training rows, at most rows_per_class of each class.

    The rows of a class with the smallest id hashes are taken. Null labels and ids are passed over;
    an id that labels holds more than once counts with its smallest label. Only ids and labels of
    the bounded sample are broadcast.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(target).alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(train("id")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = reduce(DataFrame.union, [known.where(F.col("label") == F.lit(c)).orderBy(F.xxhash64("id"), "id").limit(rows_per_class) for c in classes])
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")


def class_sizes(labels: DataFrame, target: str, train: Callable[[str], Column] = lambda c: fold(c, 5) != 0, id_col: str = "doc_id") -> dict:
    """How many labelled training rows each class has."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).where(train(id_col)).groupBy(F.col(target).alias("label")).count().collect()
    return {r["label"]: r["count"] for r in rows}


def append(docs: DataFrame, text_col: str, added: dict[str, T.DataType], run: Callable[[pa.Array], dict[str, pa.Array]], keep_text: bool, chunk: int = text.CHUNK_BYTES) -> DataFrame:
    """docs with columns that run makes of a run of texts; columns by their names, upper and lower case alike, are replaced."""
    names = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    kept = [c for c in names if keep_text or c != text_col]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in text.slices(batch, text_col, chunk):
                found = run(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(found[k] for k in added)], names=[*kept, *added])

    return map_batches(docs.select(*names), batches, T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, t) for k, t in added.items()]))


def calibrate(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to P(label 1), by damped Newton steps."""
    w, t = np.array([1.0, 0.0]), labels.astype(np.float64)
    x = np.stack([margins.astype(np.float64), np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weights * (p - t)) + np.array([1e-3 * (w[0] - 1), 0])
        h = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, float(np.abs(step).max()))
    return max(float(w[0]), 1e-6), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
