"""Full-text search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import search
from marlstone.operators.search import TextIndex, fuse


def brute(docs, queries, k, k1=search.K1, b=search.B):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    docs = [(i, words(t)) for i, t in docs if i is not None]
    mean, n = sum(len(w) for _, w in docs) / max(1, len(docs)), len(docs)
    unique = {(i, tuple(w)) for i, w in docs}
    df = Counter(t for _, w in unique for t in set(w))
    out = []
    for q, text in queries:
        scored = []
        for i, w in unique:
            tf = Counter(w)
            parts = [round(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / mean))), 9) for t in set(words(text)) if t in tf]
            if parts:
                scored.append((-round(sum(parts), 9), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(n):
    rng = random.Random(n)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("n, k, range_docs, pilot", [(400, 5, 8, 2), (400, 50, 8, 1), (60, 3, 256, 8), (0, 3, 256, 8)])
def test_equals_scoring_every_document(spark, tmp_path, monkeypatch, n, k, range_docs, pilot):
    monkeypatch.setattr(search, "RANGE_DOCS", range_docs)
    monkeypatch.setattr(search, "PILOT", pilot)
    docs = corpus(n) + ([(9000, None), (9001, ""), (9002, "ÉCOLE école w1"), (9003, "w1"), (9003, "w1 w2 w2"), (9004, "w1 w2"), (9004, "w1 w2"), (None, "w1"), (9005, "w5 " * 30000)] if n else [])
    queries = [(1, "w1 w2 w3"), (2, "W7 w7, w250!"), (3, "nowhere"), (4, None), (5, "École"), (6, "w1 " * 50 + "w9"), (7, " ".join(f"w{i}" for i in range(300)))]
    frame = spark.createDataFrame([(i, t, 0.0, "x") for i, t in docs], "doc_id bigint, text string, score double, term string").repartition(3)
    index = TextIndex(spark, str(tmp_path))
    assert not index.ready()
    index.build(frame)
    assert index.ready()
    got = index.search(spark.createDataFrame(queries + [(None, "w1")], "query_id int, text string"), k).collect()
    expected = brute(docs, queries, k)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == sorted(x[:3] for x in expected)
    for r, e in zip(sorted(got), sorted(expected)):
        assert math.isclose(r["score"], e[3], abs_tol=1e-6)


def test_reads_its_terms_alone(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path)).build(spark.createDataFrame(corpus(300), "doc_id int, text string"))
    held, few = index.postings(spark.createDataFrame([("w1",), ("w2",)], "term string"))
    folders = {f.split("bucket=")[1].split("/")[0] for f in held.inputFiles()}
    assert few and {r["term"] for r in held.collect()} == {"w1", "w2"}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan.replace("Or(EqualTo(term", "In(term") and len(folders) > 2


def test_bounds_keep_ranges_closed(spark, tmp_path, monkeypatch):
    """One document that has a rare word again and again: no range but its own is opened after the first ones."""
    monkeypatch.setattr(search, "RANGE_DOCS", 10)
    docs = [(i, f"common filler{i}") for i in range(1000)] + [(5000 + i, "rare rare rare common") for i in range(3)]
    index = TextIndex(spark, str(tmp_path)).build(spark.createDataFrame(docs, "doc_id int, text string"))
    asked = spark.createDataFrame([(1, "rare common")], "query_id int, text string")
    assert sorted(r["id"] for r in index.search(asked, 3).collect()) == [5000, 5001, 5002]
    assert index.opened(asked, 3).count() <= 3 < index.opened(asked, 4).count()


def test_fused_ranks(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 30)], "query_id int, rank int, id int")
    b = spark.createDataFrame([(1, 1, 20), (1, 2, 40)], "query_id int, rank int, id int")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in fuse([a, b], 2).collect()}
    assert got == {(1, 1): (20, round(1 / 62, 9) + round(1 / 61, 9)), (1, 2): (10, round(1 / 61, 9)), (2, 1): (30, round(1 / 61, 9))}


def test_neighbours_by_blocks_of_queries(spark, sf_dir, monkeypatch):
    """However queries are cut into blocks, each has the neighbours that it has in one."""
    from marlstone.operators import vector

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(vector.nearest(vectors, queries, 3).collect())
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert sorted(vector.nearest(vectors, queries, 3).collect()) == whole and len(whole) == 3 * queries.count()


@pytest.mark.parametrize("queries, docs, terms", [(1, 4096, 16_384), (512, 3, 16_384), (2, 5, 7)])
def test_scores_by_blocks(spark, tmp_path, monkeypatch, queries, docs, terms):
    """However a range's queries, documents and terms are cut into blocks, the results are those of scoring every document."""
    for name, value in (("RANGE_DOCS", 40), ("QUERIES", queries), ("DOCS", docs), ("TERMS", terms)):
        monkeypatch.setattr(search, name, value)
    rows, asked = corpus(120), [(1, "w1 w2 w3"), (2, "w7 w250"), (3, " ".join(f"w{i}" for i in range(100)))]
    index = TextIndex(spark, str(tmp_path)).build(spark.createDataFrame(rows, "doc_id int, text string"))
    got = index.search(spark.createDataFrame(asked, "query_id int, text string"), 4).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in got) == sorted((*x[:3], round(x[3], 6)) for x in brute(rows, asked, 4))


def test_shuffles_no_row_for_each_posting(spark, tmp_path):
    """Neither building nor searching makes a row of each word or posting: a range's texts and postings move whole."""
    index = TextIndex(spark, str(tmp_path)).build(spark.createDataFrame(corpus(50), "doc_id int, text string"))
    plan = index.search(spark.createDataFrame([(1, "w1 w2")], "query_id int, text string"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(postings" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("tile", [2, 2048])
def test_neighbours_of_odd_vectors(spark, monkeypatch, tile):
    """Null, zero, NaN and shorter vectors, copies and repeated ids rank as a sort of all pairs ranks them."""
    from marlstone.operators import vector

    monkeypatch.setattr(vector, "TILE_ROWS", tile)
    monkeypatch.setattr(vector, "TILE_QUERIES", tile)
    rng = random.Random(5)
    some = [[rng.choice([-1.0, 0.5, 0.3, 2.0]) for _ in range(3)] for _ in range(12)]
    rows = [(i, some[i % 12]) for i in range(60)] + [(7, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (100, None), (101, [0.0] * 3), (102, [float("nan"), 1.0, 0.0]), (103, [1.0]), (104, [1.0, None, 1.0]), (105, []), (None, some[0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    q = spark.createDataFrame(rows[:8] + rows[62:], "query_id bigint, query_vector array<float>").where("query_id is not null")
    for k in (3, 66, 100):
        pairs = v.crossJoin(q).select("query_id", F.col("vec_id").alias("id"), vector.dot(vector.unit(F.col("embedding")), vector.unit(F.col("query_vector"))).alias("s"))
        order = "row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, id)"
        wanted = pairs.selectExpr("query_id", "id", "round(s, 4) AS similarity", f"{order} AS rank").where(F.col("rank") <= k)
        text = lambda df: sorted(str(tuple(r)) for r in df.collect())
        assert text(vector.nearest(v, q, k)) == text(wanted)


def test_neighbours_make_no_row_of_a_pair(spark, sf_dir):
    from marlstone.queries import QUERIES

    for name in ("vec_knn_cosine", "vec_ann_cosine"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "query_vector" not in plan
