"""Collocations against brute force over every phrase of every piece."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import cells

from marlstone.llm import collocations
from marlstone.llm.oracles import ORACLES
from marlstone.llm.queries import QUERIES
from pyspark.sql import functions as F


def _pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, longest, percent, per_lang):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {}
    every = [(lang, p, a) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    for lang, p, a in every:
        holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and 100 * b >= percent * a and holds(q) for o, q, b in every):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang], k))
    return [(lang, rank, p.decode(), -a, l, r, m, -s, k) for lang, all_ in found.items() for rank, (s, a, p, l, r, m, k) in enumerate(sorted(all_)[:per_lang], 1)]


def test_query_equals_sql(spark, duck):
    """Over documents of sf0.01: in smaller tables hardly a phrase is frequent."""
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    df, answer = QUERIES["op12_pair_naming_collocations"](spark, "/root/testdata/sf0.01"), con.sql(ORACLES["op12_pair_naming_collocations"])
    rows = df.collect()
    assert len(rows) > 50 and sorted(df.columns) == sorted(answer.columns)
    assert cells(rows, df.columns) == cells(answer.fetchall(), answer.columns)


@pytest.mark.parametrize("block, longest, percent, per_lang, shard, heavy", [(1 << 20, 5, 100, 2000, 1 << 20, 1 << 20), (40, 5, 80, 2000, 100, 1 << 20), (300, 3, 100, 7, 100, 0), (40, 2, 100, 5, 1 << 20, 0)])
def test_phrases(spark, monkeypatch, block, longest, percent, per_lang, shard, heavy):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "HEAVY_HASHES", heavy)
    rng = random.Random(block)
    common = ["new york city", "of the", "In The Middle of", "a b c d e f", "é ü 漢字"]
    rows = []
    for i in range(120):
        said = " ".join(rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(12)}" for _ in range(rng.choice([1, 4, 30])))
        rows.append((re.sub(" w1 ", rng.choice([". ", ",", " ;; ", "\n", "\t", "  "]), said), rng.choice(["en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" \t .,\n", "de"), ("a b c d e f " * 300, "en"), ("x" * 50000, "en"), rows[0], rows[0]]
    docs = spark.createDataFrame([(t, lang, 1, 2, "x") for t, lang in rows], "text string, lang string, id int, n int, `rank` string").repartition(3)
    out = collocations.collocations(docs, 5, longest, percent, per_lang, block_bytes=block)
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, 5, longest, percent, per_lang))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]


def test_nothing_frequent(spark):
    for rows in ([], [("one two", "en")], [(None, None)]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_products_past_64_bits(spark):
    """The score of counts whose products need 100 bits, by the expression that the operator uses."""
    a, n, l, r = 3_000_000_007, 10**14 + 9, 5_000_000_011, 4_000_000_003
    big = lambda c: f"cast({c} as decimal(20,0))"
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(l).alias("l"), F.lit(r).alias("r")).selectExpr(f"({big('a')} * 1000 * {big('n')}) div ({big('l')} * {big('r')}) as s").first()["s"]
    assert got == 1000 * a * n // (l * r)


def test_words_know_their_piece():
    found, piece, row = collocations.words(pa.array(["A b,c", None, "", "É d"]))
    assert [x.decode() for x in found.to_pylist()] == ["a", "b", "c", "É", "d"]
    assert row.tolist() == [0, 0, 0, 3, 3]
    assert piece[0] == piece[1] != piece[2] != piece[3] == piece[4]


def test_ranks_in_rounds(spark):
    rows = spark.range(5000).select(F.lit("x").alias("lang"), (F.col("id") * 7919 % 5000).alias("score"), F.col("id").cast("string").alias("phrase"))
    got = collocations.first_of_each(rows, "lang", [F.col("score").desc()], 100, "phrase").collect()
    assert sorted((r["rank"], r["score"]) for r in got) == [(i + 1, 4999 - i) for i in range(100)]
