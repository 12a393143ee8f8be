"""Exact nearest neighbours by cosine, re-ranking, hashed character-gram vectors and keyed upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a hashed vector, and of the character pieces that it counts.
DIMENSIONS, PIECE = 384, 3
#: Queries that are broadcast at a time.
QUERY_BLOCK = 10_000
#: Queries and rows that one matrix product takes at most.
TILE_QUERIES, TILE_ROWS = 1024, 2048
#: How far a matrix product's sums may lie from sums in order; what lies nearer to the k-th best is summed again in order.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def unit(v: Column) -> Column:
    """A vector divided by its length; null for a vector of zeros."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, similarity, rank): the k vectors nearest to each query by unrounded cosine, ties by id; shown to 4 digits.

    Queries are broadcast in blocks of about QUERY_BLOCK, a scan of the vectors for each, so that
    no broadcast grows with them. A task holds a tile of scores and the best k of each query of the
    block, whatever it reads; pairs are never rows.
    """
    asked = queries.select(query_id, unit(F.col(query_vector)).alias("__q"), F.array(F.lit(0)).alias("__lists"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("__v")).sortWithinPartitions("id")
    return best_in_lists(rows.select("id", F.lit(0).alias("list"), unit(F.col("__v")).alias("__v")), asked, k, query_id)


def best_in_lists(rows: DataFrame, asked: DataFrame, k: int, query_id: str = "query_id", pruned: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank) of the k best rows (id, list, __v) of the lists that each query (query_id, __q, __lists) opens.

    Rows come sorted by id within each partition, which settles ties there. pruned: rows of lists that no query opens aren't read.
    """
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = f"{query_id} {asked.schema[query_id].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, __s double"
    found = None
    for b in range(blocks):
        block = (asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else asked).select(query_id, "__q", "__lists").toArrow()
        read = rows
        if pruned:
            read = rows.where(F.col("list").isin(pc.unique(pc.list_flatten(block["__lists"])).to_pylist()))
        own = read.select("id", "list", "__v").mapInArrow(_scan(rows.sparkSession.sparkContext.broadcast(block), k, query_id), out)
        found = own if found is None else found.unionByName(own)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("__s").desc_nulls_last(), F.col("id")))).where(F.col("rank") <= k)
    return ranked.select(query_id, "id", F.round("__s", 4).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _scan(block, k: int, query_id: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives a partition's best k rows of each query of the broadcast block.

    Scores are ordered as Spark orders them: NaN above all numbers, null (a vector without
    direction, or of another length) below. A matrix product finds what may be among the best k;
    only that is summed in the order of the components, so that equal vectors have equal scores.
    """

    def by_width(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, vectors) for each length."""
        width = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        return [(at := np.flatnonzero(width == w), column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w)) for w in np.unique(width) if w >= 0]

    def one(column: pa.ChunkedArray):
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    def first_k(q: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of each query, sorted."""
        sort = np.lexsort((place, -order, q))
        q, order, place = q[sort], order[sort], place[sort]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], order[keep], place[keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        n = len(asked)
        lists = one(asked["__lists"])
        of = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        opens = lists.flatten().to_numpy(zero_copy_only=False)
        queries = by_width(one(asked["__q"]))
        # The best so far: (query, order, place), order with infinities for NaN and null, and the ids by place.
        q_, s_, p_ = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
        ids, full = None, np.full(n, -np.inf)  # full: the k-th best order, once there are k
        have, base = np.zeros(n, "int64"), 0

        def tiles(table: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(queries, orders, rows) of the pairs that may be among the best k."""
            of_list = table["list"].to_numpy(zero_copy_only=False)
            vectors = by_width(one(table["__v"]))
            for name in np.unique(of_list):
                open_, mine = np.unique(of[opens == name]), np.flatnonzero(of_list == name)
                for q0 in range(0, len(open_), TILE_QUERIES):
                    qs = open_[q0 : q0 + TILE_QUERIES]
                    approx = np.full((len(qs), len(mine)), -np.inf)
                    exact: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
                    for at, v in vectors:
                        for where, q in queries:
                            if q.shape[1] == v.shape[1]:
                                _, qi, qj = np.intersect1d(qs, where, return_indices=True)
                                _, vi, vj = np.intersect1d(mine, at, return_indices=True)
                                with np.errstate(all="ignore"):
                                    product = q[qj] @ v[vj].T
                                approx[np.ix_(qi, vi)] = np.where(np.isnan(product), np.inf, product)
                                own_q, own_v = np.full(len(qs), -1), np.full(len(mine), -1)
                                own_q[qi], own_v[vi] = qj, vj
                                exact.append((own_q, own_v, q, v))
                    least = full[qs]
                    if len(mine) > k:
                        least = np.maximum(least, np.partition(approx, -k, axis=1)[:, -k])
                    i, j = np.nonzero((approx >= least[:, None] - SLACK) & ((have[qs] < k)[:, None] | (approx > -np.inf)))
                    order = approx[i, j]
                    for own_q, own_v, q, v in exact:
                        x = np.flatnonzero((own_q[i] >= 0) & (own_v[j] >= 0) & np.isfinite(order))
                        a, b, total = own_q[i[x]], own_v[j[x]], np.zeros(len(x))
                        for c in range(q.shape[1]):
                            total += v[b, c] * q[a, c]
                        order[x] = total
                    yield first_k(qs[i], order, mine[j])

        for whole in batches:
            for start in range(0, whole.num_rows, TILE_ROWS):
                table = whole.slice(start, TILE_ROWS)
                own = one(table["id"])
                # Places of the rows that are kept go on in the order of the ids.
                new = list(tiles(table))
                q_, s_, p_ = first_k(np.concatenate([q_, *[x[0] for x in new]]), np.concatenate([s_, *[x[1] for x in new]]), np.concatenate([p_, *[x[2] + base for x in new]]))
                have = np.bincount(q_, minlength=n)
                last = np.searchsorted(q_, np.arange(n), side="right") - 1
                if len(q_):
                    full = np.where(have >= k, s_[last], -np.inf)
                # Only the ids of rows that are still among the best are kept.
                all_ = own if ids is None else pa.concat_arrays([ids, own])
                used, p_ = np.unique(p_, return_inverse=True)
                ids, base = all_.take(pa.array(used)), len(used)
        if len(q_):
            score = pa.array(np.where(np.isposinf(s_), np.nan, s_), mask=np.isneginf(s_))
            yield pa.RecordBatch.from_arrays([one(asked[query_id].take(pa.array(q_))), ids.take(pa.array(p_)), score], [query_id, "id", "__s"])

    return scan


def rerank(candidates: DataFrame, score: Column, k: int, query_id: str = "query_id", tiebreak: str = "id") -> DataFrame:
    """The k candidates of each query with the highest score; equal scores keep the order of tiebreak."""
    ranked = candidates.withColumn("cross_score", score)
    order = Window.partitionBy(query_id).orderBy(F.col("cross_score").desc(), F.col(tiebreak))
    return ranked.withColumn("rerank", F.row_number().over(order).cast("bigint")).where(F.col("rerank") <= k)


def hashed_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, n): how often pieces of up to three characters, from every place of every word, fall in a bucket."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: w.substr(i, F.lit(PIECE)))))
    bucket = F.conv(F.substring(F.md5("piece"), 1, 8), 16, 10).cast("bigint") % DIMENSIONS
    return texts.select(F.col(id_col).alias("id"), F.explode(pieces).alias("piece")).select("id", bucket.alias("bucket")).groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def embed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight) of the unit vector of each text; a text without words has no rows."""
    counts = hashed_counts(texts, id_col, text_col)
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def upsert(table: DataFrame, rows: DataFrame, key: str, replaced: list[str]) -> DataFrame:
    """table with rows merged by key: known keys take the replaced columns of their row, new keys are added whole."""
    new = rows.select(F.col(key).alias("__key"), F.struct(*rows.columns).alias("__new"))
    joined = table.join(new, table[key] == new["__key"], "full")
    kept = table[key].isNotNull()
    return joined.select(*[F.when(kept & (F.lit(c not in replaced) | F.col("__new").isNull()), table[c]).otherwise(F.col(f"__new.{c}")).alias(c) for c in table.columns])


def content(columns: DataFrame) -> DataFrame:
    """(fqn, display_name, content): what is embedded of each table, from (schema_name, table_name, column_name, position)."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]), ", ")
    tables = columns.groupBy("schema_name", "table_name").agg(names.alias("names"))
    return tables.select(F.concat_ws(".", "schema_name", "table_name").alias("fqn"), F.col("table_name").alias("display_name"), F.concat(F.lit("Table "), "table_name", F.lit(" in schema "), "schema_name", F.lit(" with columns: "), "names").alias("content"))


def prompt_search(documents: DataFrame, prompts: DataFrame, score: Column, fetch: int = 10, k: int = 3, degraded: bool = False) -> DataFrame:
    """(prompt_id, fqn, similarity, cross_score, rank): documents near each prompt by hashed vectors, re-ranked by `score` of prompt and content.

    documents: (fqn, content), prompts: (prompt_id, prompt). Hashed vectors are a stand-in for a
    trained encoder, so they are refused unless the caller asks for them. Vectors meet on their
    buckets; the similarity is exact, and only documents that share a piece with a prompt appear.
    """
    if not degraded:
        raise ValueError("no trained encoder is at hand; pass degraded=True to search by hashed vectors")
    own = hashed_counts(documents, "fqn", "content")
    asked = hashed_counts(prompts, "prompt_id", "prompt").withColumnsRenamed({"id": "prompt_id", "n": "m"})
    size = lambda c, i, n, name: c.groupBy(i).agg(F.sqrt(F.sum(F.col(n) * F.col(n)).cast("double")).alias(name))
    dots = own.join(F.broadcast(asked), "bucket").groupBy("prompt_id", "id").agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("dot"))
    scored = dots.join(size(own, "id", "n", "a"), "id").join(size(asked, "prompt_id", "m", "b"), "prompt_id").withColumn("s", F.col("dot") / (F.col("a") * F.col("b")))
    near = scored.withColumn("n", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("s"), "id"))).where(F.col("n") <= fetch)
    both = near.select("prompt_id", F.col("id").alias("fqn"), F.round("s", 4).alias("similarity")).join(documents.select("fqn", "content"), "fqn").join(F.broadcast(prompts), "prompt_id")
    return rerank(both, score, k, "prompt_id", "fqn").select("prompt_id", "fqn", "similarity", "cross_score", F.col("rerank").alias("rank"))
