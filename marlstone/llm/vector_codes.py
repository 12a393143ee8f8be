"""Product quantisation in whole numbers; nearest codebook entries by annular norm pruning.

A vector is cut into equal parts, and each part position has a codebook of its own. |x - c| is
never less than the difference of the norms of x and c, so with the entries of a codebook in order
of their norms, those that could be as near as the best one known lie in one interval (an annulus
around the origin): binary search finds it, and only its entries are measured, in whole numbers.

Spark holds the rows; a task sums what it assigns to each entry, and the driver gets one row for
each number of the codebooks in each round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.sized import with_totals
from marlstone.llm.store import Scratch, map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


class Codebook:
    """The entries of one part position, by norm; entries (n, width) of int64."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries * entries).sum(axis=1, dtype=np.int64).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def _distance(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        gap = x - self.entries[self.order[place]]
        return (gap * gap).sum(axis=1, dtype=np.int64)

    def annulus(self, norms: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (first, after the last) of entries that could lie within the squared distances, both ends included.

        Norms are rounded; the interval is widened by more than rounding can move them.
        """
        reach = np.sqrt(distances.astype(np.float64))
        reach += 1e-9 * (1.0 + reach + norms)
        return np.searchsorted(self.norms, norms - reach, side="left"), np.searchsorted(self.norms, norms + reach, side="right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x (n, width) and its squared distance; of equal distances the least index.

        The search begins at the entry of the nearest norm and goes outwards on both sides; each
        better entry narrows the annulus that is left.
        """
        norms = np.sqrt((x * x).sum(axis=1, dtype=np.int64).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        start = np.where(norms - self.norms[below] <= self.norms[above] - norms, below, above)
        best, found = self._distance(x, start), self.order[start]
        low, high = self.annulus(norms, best)
        for step in range(1, len(self.norms)):
            for place in (start - step, start + step):
                rows = np.flatnonzero((place >= low) & (place < high))
                if not len(rows):
                    continue
                at = place[rows]
                distance, index = self._distance(x[rows], at), self.order[at]
                better = (distance < best[rows]) | ((distance == best[rows]) & (index < found[rows]))
                rows = rows[better]
                best[rows], found[rows] = distance[better], index[better]
                low[rows], high[rows] = self.annulus(norms[rows], best[rows])
            if not ((start - step > low) | (start + step + 1 < high)).any():
                break
        return found, best


def _ints(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(books: np.ndarray):
    """Tasks' sums: rows (slot, total, n), a slot for each number of the codebooks."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Codebook(b) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _ints(batch.column("v"), parts * width).reshape(-1, parts, width)
            for p, coder in enumerate(coders):
                found, _ = coder.nearest(x[:, p])
                n[p] += np.bincount(found, minlength=entries)
                chosen = (found[:, None] == np.arange(entries)).astype(np.float64)
                total[p] += (chosen.T @ x[:, p].astype(np.float64)).astype(np.int64)  # a batch's sums are exact in 53 bits
        slots = np.flatnonzero(np.repeat(n.ravel(), width))
        if len(slots):
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total.ravel()[slots]), pa.array(np.repeat(n.ravel(), width)[slots])], names=["slot", "total", "n"])

    return run


def _codes(books: np.ndarray):
    parts, entries, width = books.shape
    size = next(b for b in (1, 2, 4) if entries <= 256**b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Codebook(b) for b in books]
        for batch in batches:
            x = _ints(batch.column("v"), parts * width).reshape(-1, parts, width)
            codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p, coder in enumerate(coders):
                codes[:, p], distance = coder.nearest(x[:, p])
                error += distance
            text = pa.array(np.frombuffer(codes.astype(f">u{size}").tobytes().hex().encode(), dtype=f"S{2 * size * parts}").tolist(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def whole_numbers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """Rows (vec_id, label, v) of the vectors that are kept, in whole numbers, and their length (0 if none is kept)."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % parts == 0))
    least = rows.where(F.col("vec_id").isNotNull()).agg(F.min(F.struct("vec_id", F.size("v").alias("n")))["n"].alias("n")).first()["n"]
    size = least or rows.agg(F.min(F.size("v")).alias("n")).first()["n"] or 0
    bound = math.isqrt((1 << 62) // max(size, 1)) // 2
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(bound)), F.lit(-bound)).cast("int"))
    return rows.where(F.size("v") == size).select("vec_id", "label", whole.alias("v")), size


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (part, entry, position).

    Rows (vec_id, label, code, error, label_error): code has the index of each part's entry in hex,
    two digits where there are 256 entries or fewer; error is the squared distance to the coded
    vector; label_error is its sum over equal labels, nulls together (null past 64 bits).

    A component x becomes floor(scale * x). Codebooks begin as the parts of the rows with the least
    ids, repeated ids in order of their vectors; in each round an entry becomes the floored mean of
    the parts nearest to it, and an entry that none is nearest to stays. Equal distances go to the
    entry of the lower index. With fewer rows than entries there are as many entries as rows.

    Rows are dropped whose vector is null, empty, holds a null or a number that isn't finite, or
    has another length than the vector of the least id whose length the parts divide. Rows with a
    null id are coded but begin no codebook (unless all ids are null: then the least vectors do).
    Numbers so large that squared distances would pass 64 bits count as the largest that don't
    (32,768 before scaling at 64 components). Other columns are left behind.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    rows, size = whole_numbers(vectors, parts, scale, id_col, vector_col, label_col)
    rows = scratch.write(rows, "whole")
    width = size // parts
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries)
    if not rows.where("vec_id is not null").isEmpty():
        seeds = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries)
    first = [r["v"] for r in seeds.select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy() if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first else 0):
        sums = map_batches(rows.select("v"), _sums(books), "slot bigint, total bigint, n bigint")
        for r in sums.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect():
            books.ravel()[r["slot"]] = int(r["total"]) // r["n"]
    kinds = rows.schema
    coded = map_batches(rows, _codes(books), f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error bigint")
    coded = scratch.write(coded, "codes")
    scratch.drop(keep=("codes",))
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return with_totals(coded, totals, "label", "label_error", F.col("code")), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks, in order of part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
