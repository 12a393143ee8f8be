"""SpotSigs against brute force in plain Python, and against SQL."""

import hashlib
import math
import random
import re

import pytest
from conftest import cells

from marlstone.llm import spotsigs
from marlstone.llm.oracles import ORACLES
from marlstone.llm.queries import QUERIES
from pyspark.sql import functions as F


def spots(text, chain=spotsigs.CHAIN):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[一-鿿]|[぀-ヿ]|[^\W_]+", low)
    content, waiting = [], []
    for w in words:
        if w in spotsigs.ANCHORS:
            waiting.append(w)
        else:
            content.append((tuple(waiting), w))
            waiting = []
    spot = lambda i: " ".join(["\x02".join([*("\x01" + a for a in content[i][0]), content[i][1]]), *(w for _, w in content[i + 1 : i + chain])])
    found = [spot(i) for i, (a, _) in enumerate(content) if a] or [spot(i) for i in range(len(content))] or [text or ""]
    return sorted({hashlib.md5(s.encode()).hexdigest()[: spotsigs.DIGITS] for s in found})


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b})


def texts():
    rng = random.Random(5)
    content, common = [f"w{i}" for i in range(40)], ["the", "of", "The", "und", "la"]
    said = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(content) + rng.choice(["", ",", "."]) for _ in range(n))
    own = [said(n) for n in (1, 2, 3, 5, 30, 30, 200, 200, 5000)]
    return own + [None, "", " ", "!!!", "the of the", "no anchors here-none", "日本語 の テスト the x", "é" * 10, "Straße the ÉCOLE", own[5], own[5] + " end", "z" * 20000, "a\x00b"]


def test_query_equals_sql(spark, sf_dir, duck):
    df, answer = QUERIES["op13_spotsigs"](spark, sf_dir), duck.sql(ORACLES["op13_spotsigs"])
    assert sorted(df.columns) == sorted(answer.columns)
    assert cells(df.collect(), df.columns) == cells(answer.fetchall(), answer.columns)


@pytest.mark.parametrize("spread", [1, 10**15])
def test_fingerprints(spark, spread):
    rows = [(k * spread - 7 * k * k, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, next string, n_chars int").repartition(3)
    got = {r["doc_id"]: r for r in spotsigs.compared_with_next(docs).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i]
        assert (r["n_chars"], r["edited"]) == (len(t), edited)
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(spots(t)), "".join(spots(edited)))
        assert math.isclose(r["near_edited"], jaccard(spots(t), spots(edited))) and math.isclose(r["near_next"], jaccard(spots(t), spots(after)))


def test_next_over_ranges(spark):
    """Every range hands over to the one before; ids repeat, and null ids have no next."""
    for ids in (range(0, 900, 3), [5], [7, 7, 7, 1, 1], []):
        rows = [(i, f"text {i} {k}") for k, i in enumerate(ids)]
        nulls = [(None, "a"), (None, None)]
        docs = spark.createDataFrame(rows + nulls, "doc_id bigint, text string").repartition(3)
        got = spotsigs.with_next(docs, ["doc_id", "text"], ranges=16).collect()
        assert sorted((r["text"] or "") for r in got if r["doc_id"] is None and r["next"] is None) == ["", "a"]
        own = [r for r in got if r["doc_id"] is not None]
        assert sorted((r["doc_id"], r["text"]) for r in own) == sorted(rows)
        assert sorted((r["next"]["doc_id"], r["next"]["text"]) for r in own) == sorted(rows)  # a ring: each is the next of one
        distinct = sorted({*ids}, reverse=True)
        after = dict(zip(distinct, distinct[1:] + distinct[:1]))
        assert all(r["next"]["doc_id"] in (r["doc_id"], after[r["doc_id"]]) for r in own)
        for i in distinct:
            assert sum(r["next"]["doc_id"] != i for r in own if r["doc_id"] == i) == (len(distinct) > 1)


def test_length_partitions_prune_nothing_alike(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = {rng.randrange(40) for _ in range(rng.randrange(1, 30))}
        b = {x for x in a if rng.random() < 0.9} | {rng.randrange(40) for _ in range(rng.randrange(3))}
        pairs.append((sorted(map(str, a)), sorted(map(str, b))))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    least = 0.75
    got = df.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b")).alias("all"), spotsigs.likeness(F.col("a"), F.col("b"), least).alias("some"), (spotsigs.length_partition(F.col("a"), least) - spotsigs.length_partition(F.col("b"), least)).alias("apart")).collect()
    for r in got:
        true = jaccard(r["a"], r["b"])
        assert math.isclose(r["all"], true) and math.isclose(r["some"], true if true >= least else 0.0)
        assert true < least or abs(r["apart"]) <= 1
    assert {abs(r["apart"]) for r in got} > {0, 1}


def test_native(spark, sf_dir):
    plan = spotsigs.compared_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert spotsigs.compared_with_next(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
