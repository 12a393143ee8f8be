"""Full-text search: a stored inverted index, BM25 with block bounds, and rank fusion.

Documents are dealt to ranges of about as many documents each. A row of the index holds a term's
postings in one range (ids, how often, lengths) and the most that any of them can add to a score.
A range's texts are brought together once and inverted in place, so that no row for each word of a
text is ever shuffled. Rows are stored by a hash of the term, in order of terms, so that a query reads
its own terms' part of the index alone. For a query, the bounds of its terms add up to a bound for
each range; a few ranges of the highest bounds are scored first, and the score of the k-th best
document there rules out every range whose bound is lower. Postings of other ranges are never
opened; those of an open range meet its queries in one place, and only the best documents leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import unicode_words

#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: Folders of the index, documents of a range, ranges that a task inverts (their postings of a folder share a file), ranges that are scored first.
BUCKETS, RANGE_DOCS, RANGES_OF_FILE, PILOT = 64, 256, 64, 8
#: The form of the stored rows; an index of another form isn't ready.
FORM = 2
#: Queries, documents and terms that one matrix product of a range takes at most; whole numbers that it sums stay exact below 2^53.
QUERIES, DOCS, TERMS = 512, 4096, 16_384
#: Terms of all queries together that are broadcast at most.
BROADCAST_TERMS = 100_000
#: Terms that a filter of the stored rows names at most.
NAMED_TERMS = 1000
#: A term's part of a score is a whole number of this many decimals, so that sums don't depend on their order.
DECIMALS = 9


def _postings(id_type: str) -> str:
    """The type of a term's postings in a range; doc tells the range's documents apart."""
    return f"array<struct<id:{id_type},doc:int,tf:int,len:int>>"


def _inverter(k1: float, b: float, mean: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Turns the documents of a range (id, key, said: its words) into rows (term, range, postings, most, n)."""

    def inverted(key: tuple, docs: pa.Table) -> pa.Table:
        docs = docs.append_column("row", pa.array(np.arange(len(docs))))
        first = docs.group_by(["id", "key"]).aggregate([("row", "min")])["row_min"].to_numpy()
        docs = docs.take(pa.array(np.sort(first)))
        words = pc.split_pattern(docs["said"], " ").combine_chunks()
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype("int64")
        coded = words.flatten().dictionary_encode()
        # One number for each place: its term and, within the term, its document.
        at, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype("int64") * len(docs) + np.repeat(np.arange(len(docs)), length), return_counts=True)
        code, doc = np.divmod(at, max(1, len(docs)))
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
        ids = docs["id"].combine_chunks().take(pa.array(doc))
        postings = pa.StructArray.from_arrays([ids, pa.array(doc, "int32"), pa.array(tf, "int32"), pa.array(length[doc], "int32")], ["id", "doc", "tf", "len"])
        ends = np.append(starts, len(at))
        lists = pa.ListArray.from_arrays(pa.array(ends, "int32"), postings)
        most = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0)
        return pa.table({"term": coded.dictionary.take(pa.array(code[starts])), "range": pa.array(np.full(len(starts), key[0].as_py()), "int64"), "postings": lists, "most": pa.array(most), "n": pa.array(np.diff(ends), "int32")})

    return inverted


def _scorer(k: int, k1: float, b: float, mean: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The best k documents of a range, and those that tie with the k-th, for each query (query_id, terms) that opens it; scores in units of the last decimal."""

    def scored(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        query, doc, score = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        ids = pa.nulls(0, held["postings"].type.value_type.field("id").type)
        if len(held) and len(asked):
            lists = held["postings"].combine_chunks()
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
            term, tf = np.repeat(np.arange(len(held)), n), field("tf")
            y = held["idf"].to_numpy()[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * field("len") / mean))) * 10**DECIMALS
            part = np.floor(y)
            part += y - part >= 0.5
            _, first, own = np.unique(field("doc"), return_index=True, return_inverse=True)
            ids = flat.field("id").take(pa.array(first))
            wanted = asked["terms"].combine_chunks()
            of = pc.index_in(wanted.flatten(), held["term"].combine_chunks()).to_numpy(zero_copy_only=False)
            by = np.repeat(np.arange(len(asked)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            by, of = by[~np.isnan(of)], of[~np.isnan(of)].astype("int64")
            for q0 in range(0, len(asked), QUERIES):
                for d0 in range(0, len(first), DOCS):
                    shape = (min(QUERIES, len(asked) - q0), min(DOCS, len(first) - d0))
                    total, hit = np.zeros(shape, "int64"), np.zeros(shape, bool)
                    for t0 in range(0, len(held), TERMS):
                        a = np.zeros((shape[0], min(TERMS, len(held) - t0)))
                        x = (by >= q0) & (by < q0 + shape[0]) & (of >= t0) & (of < t0 + a.shape[1])
                        a[by[x] - q0, of[x] - t0] = 1
                        used = np.flatnonzero(a.any(axis=0))
                        p = np.zeros((a.shape[1], shape[1]))
                        x = (own >= d0) & (own < d0 + shape[1]) & (term >= t0) & (term < t0 + a.shape[1])
                        p[term[x] - t0, own[x] - d0] = part[x] + 1  # so that a part of nothing is seen
                        a, p = a[:, used], p[used]
                        found = (a @ (p > 0)).astype("int64")
                        total += (a @ p).astype("int64") - found
                        hit |= found > 0
                    ranked = np.where(hit, total, -1)
                    least = np.partition(ranked, -k, axis=1)[:, -k] if k < shape[1] else np.full(shape[0], -1)
                    qs, ds = np.nonzero(hit & (ranked >= least[:, None]))
                    query.append(qs + q0), doc.append(ds + d0), score.append(total[qs, ds])
        query, doc = pa.array(np.concatenate(query)), pa.array(np.concatenate(doc))
        return pa.table({"query_id": asked["query_id"].take(query), "id": ids.take(doc), "units": pa.array(np.concatenate(score))})

    return scored


class TextIndex:
    """An index in a folder that all executors share; k1 and b are the index's, since its bounds hold for them alone."""

    def __init__(self, spark: SparkSession, folder: str, k1: float = K1, b: float = B):
        self.spark, self.folder, self.k1, self.b = spark, folder.rstrip("/"), k1, b

    def ready(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/stats-{FORM}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
        """Write the index of docs; statistics come last, so an index that was cut short isn't ready.

        Words are lower-cased runs of letters, digits and underscores. A document without words
        counts among the documents and has no postings; null text is empty. Rows that repeat an id
        with another text are documents of their own; whole repeated rows are found once, though
        all count among the documents. Rows with a null id are left out.
        """
        text, words = F.coalesce(F.col(text_col), F.lit("")), unicode_words(F.coalesce(F.col(text_col), F.lit("")))
        rows = docs.where(F.col(id_col).isNotNull())
        kind = docs.select(id_col).schema[0].dataType.simpleString()
        n, mean = rows.agg(F.count(F.lit(1)), F.avg(F.size(words))).first()
        ranges = max(1, -(-n // RANGE_DOCS))
        placed = rows.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.array_join(words, " ").alias("said"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(ranges)).alias("range"))
        dealt = placed.where("said <> ''").repartition(-(-ranges // RANGES_OF_FILE), "range")
        held = dealt.groupBy("range").applyInArrow(_inverter(self.k1, self.b, mean or 1.0), f"term string, range bigint, postings {_postings(kind)}, most double, n int")
        stored = held.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).sortWithinPartitions("bucket", "term", "range")
        stored.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings-{FORM}")
        self.spark.createDataFrame([(n, mean, kind)], "n_docs bigint, mean double, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats-{FORM}")
        return self

    def statistics(self) -> tuple[int, float, str]:
        """Documents, their mean length in words and the type of their ids."""
        return tuple(self.spark.read.parquet(f"{self.folder}/stats-{FORM}").first())

    def postings(self, terms: DataFrame) -> tuple[DataFrame, bool]:
        """Rows (term, range, postings, most, n) of these terms, and whether the terms are few; only the folders that have terms are read."""
        kind = f"term string, range bigint, postings {_postings(self.statistics()[2])}, most double, n int, bucket int"
        stored = self.spark.read.schema(kind).parquet(f"{self.folder}/postings-{FORM}")
        folder = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        folders = [r["b"] for r in terms.select(folder.alias("b")).distinct().collect()]
        some = [r["term"] for r in terms.limit(BROADCAST_TERMS + 1).collect()]
        few = len(some) <= BROADCAST_TERMS
        found = stored.where(F.col("bucket").isin(folders))
        if len(some) <= NAMED_TERMS:
            return found.where(F.col("term").isin(some)), few
        return found.join(F.broadcast(terms) if few else terms, "term"), few

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
        """(query_id, rank, id, score): the k documents with the highest BM25 score for each query, ties by id.

        A query's repeated words count once. Queries without a word that any document has, and
        those with a null id, have no rows. Results are those of scoring every document.
        """
        return self._search(queries, k, query_id, text_col)[0]

    def opened(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
        """(query_id, range) of the ranges whose postings search() scores."""
        return self._search(queries, k, query_id, text_col)[1]

    def _search(self, queries: DataFrame, k: int, query_id: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(unicode_words(F.coalesce(F.col(text_col), F.lit(""))))).alias("term")).distinct()
        held, few = self.postings(asked.select("term").distinct())
        small = F.broadcast if few else (lambda df: df)
        n, mean, kind = self.statistics()
        df = held.groupBy("term").agg(F.sum("n").alias("df"))
        idf = small(df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
        weights = small(asked.join(idf, "term"))
        terms = small(asked.join(idf, "term", "left_semi").groupBy("query_id").agg(F.collect_list("term").alias("terms")))

        bounds = held.select("term", "range", "most").join(weights, "term").groupBy("query_id", "range").agg((F.sum(F.col("idf") * F.col("most")) * (1 + 1e-9) + 1e-6).alias("bound"))
        first = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "range")
        pilot = bounds.withColumn("r", F.row_number().over(first)).where(F.col("r") <= PILOT).select("query_id", "range")

        rows = held.select("term", "range", "postings").join(idf, "term")
        out = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kind}, units bigint"
        best = Window.partitionBy("query_id").orderBy(F.col("units").desc(), "id")

        def scored(ranges: DataFrame) -> DataFrame:
            """The best k of the documents in these ranges."""
            due = ranges.select("query_id", F.col("range").alias("opened"))
            opened = rows.join(F.broadcast(due.select("opened").distinct()), F.col("range") == F.col("opened"), "left_semi").groupBy("range")
            total = opened.cogroup(due.join(terms, "query_id").groupBy("opened")).applyInArrow(_scorer(k, self.k1, self.b, mean or 1.0), out)
            return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("score", F.col("units") / F.lit(10.0**DECIMALS))

        least = scored(pilot).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
        due = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "range")
        return scored(due).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score"), due


def fuse(rankings: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """(query_id, rank, id, score) of rankings (query_id, rank, id) fused by the sum of 1 / (constant + rank), ties by id.

    What a ranking doesn't have adds nothing. Terms are whole numbers of nine decimals, so that sums don't depend on their order.
    """
    part = F.round(1 / (F.lit(float(constant)) + F.col("rank")), DECIMALS).cast(f"decimal(18,{DECIMALS})")
    all_ = None
    for r in rankings:
        own = r.select("query_id", "id", part.alias("part"))
        all_ = own if all_ is None else all_.unionByName(own)
    total = all_.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return total.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("score").cast("double").alias("score"))
