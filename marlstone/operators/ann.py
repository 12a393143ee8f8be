"""Approximate nearest neighbours by cosine: an inverted file of lists around centroids.

Centroids are fitted on a bounded sample; every row is put in the list of its nearest centroid. A
query opens the lists nearest to it, as many as the sample needed to reach the wanted recall. A
stored index, written with partitionBy("list"), is read only in the lists that queries open.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.vector import best_in_lists, dot, unit

#: Rows that centroids are fitted on and lists at most: both bound what the driver and each task hold.
SAMPLE, LISTS = 20_000, 256
#: Sample rows that are asked to find how many lists a query must open.
ASKED = 200
#: The list of rows without direction: null, of zeros alone or of another length.
NOWHERE = -1


@dataclass(frozen=True)
class Lists:
    """Unit centroids, how many lists a query opens, and the recall that this reached on the sample."""

    centroids: np.ndarray
    probes: int
    recall: float


def _probes(rows: np.ndarray, centroids: np.ndarray, k: int, wanted: float) -> tuple[int, float]:
    """The fewest lists that hold the wanted share of the k true neighbours, found among the sample's rows."""
    asked = rows[:: max(1, len(rows) // ASKED)]
    true = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    opened_at = np.take_along_axis(place, np.argmax(rows @ centroids.T, axis=1)[true], axis=1)
    for probes in range(1, len(centroids) + 1):
        share = float((opened_at < probes).mean())
        if share >= wanted:
            return probes, share
    return len(centroids), 1.0


def fit(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", lists: int = LISTS, sample: int = SAMPLE, k: int = 10, recall: float = 0.97, rounds: int = 15) -> Lists:
    """Spherical k-means over at most `sample` rows, those with the least hash of their id.

    There are at most `lists` centroids and at most the square root of the rows. Rows without
    direction aren't sampled; an empty table gives no list.
    """
    found = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("v")).where(F.col("v").isNotNull()).orderBy(F.xxhash64("id"), "id", "v").limit(sample).toPandas()["v"]
    if not len(found):
        return Lists(np.zeros((0, 0)), 0, 1.0)
    width = found.map(len).mode()[0]
    rows = np.stack([v for v in found if len(v) == width])
    centroids = rows[: max(1, min(lists, int(len(rows) ** 0.5)))].copy()
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centroids)
    return Lists(centroids, *_probes(rows, centroids, k, recall))


def _ranked(df: DataFrame, lists: Lists, v: str) -> tuple[DataFrame, Column]:
    """df beside the centroids (one bounded row), and the lists in order of nearness to v, ties to the first."""
    rows = [(i, c.tolist()) for i, c in enumerate(lists.centroids)]
    one = df.sparkSession.createDataFrame([(rows,)], "__centroids array<struct<list: int, c: array<double>>>")
    near = F.transform("__centroids", lambda x: F.struct((-dot(x["c"], F.col(v))).alias("far"), x["list"].alias("list")))
    return df.crossJoin(F.broadcast(one)), F.array_sort(near)


def index(vectors: DataFrame, lists: Lists, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, list, v): every row with its list and its unit vector; repeated rows are indexed as they come."""
    width = lists.centroids.shape[1]
    own = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("v"))
    both, order = _ranked(own, lists, "v")
    placed = F.when(F.size("v") == width, F.get(order, F.lit(0))["list"]) if width else F.lit(None).cast("int")
    return both.select("id", F.coalesce(placed, F.lit(NOWHERE)).alias("list"), "v")


def search(indexed: DataFrame, lists: Lists, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest rows of the lists that each query opens, ties by id.

    probes: lists to open, by default what fit() found; all lists give the exact answer. Queries
    without direction, or of another length than the centroids, get no rows. Queries are broadcast
    in blocks and a task holds a tile of scores of one list at a time, so that hot lists grow nothing.
    """
    asked = queries.select(query_id, unit(F.col(query_vector)).alias("__q")).where(F.size("__q") == lists.centroids.shape[1])
    both, order = _ranked(asked, lists, "__q")
    opened = both.select(query_id, "__q", F.transform(F.slice(order, 1, max(1, probes or lists.probes)), lambda x: x["list"]).alias("__lists"))
    rows = indexed.select("id", "list", F.col("v").alias("__v")).sortWithinPartitions("id")
    return best_in_lists(rows, opened, k, query_id, pruned=True)
