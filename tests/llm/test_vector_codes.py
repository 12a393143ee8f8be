"""Vector codes against brute force: every entry measured, in whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from conftest import cells
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import sized, vector_codes
from marlstone.llm.oracles import ORACLES
from marlstone.llm.queries import QUERIES
from pyspark.sql import functions as F


def brute(rows, parts, entries, rounds):
    """rows (vec_id, vector, label) that are kept; codes, errors and the codebooks."""
    width = len(rows[0][1]) // parts
    whole = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted((i, v) for i, v, _ in whole if i is not None)[:entries]
    books = [[cut(v, p) for _, v in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, v, _ in whole:
                groups[near(cut(v, p), book)[1]].append(cut(v, p))
            for k, members in groups.items():
                book[k] = [sum(column) // len(members) for column in zip(*members)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in whole]
    errors, totals = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for e, (_, _, label) in zip(errors, whole):
        totals[label] += e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, totals[label]) for f, e, (i, _, label) in zip(found, errors, whole)], books


def test_query_equals_sql(spark, sf_dir, duck):
    df, answer = QUERIES["op11_annular_codes"](spark, sf_dir), duck.sql(ORACLES["op11_annular_codes"])
    assert sorted(df.columns) == sorted(answer.columns)
    assert cells(df.collect(), df.columns) == cells(answer.fetchall(), answer.columns)


@pytest.mark.parametrize("n, entries, rounds", [(60, 5, 3), (3, 16, 2), (200, 16, 6)])
def test_codes(spark, n, entries, rounds):
    rng = np.random.default_rng(n)
    pool = np.round(rng.normal(0, 1, (n, 8)), 1)
    pool[n // 2 :] = pool[rng.integers(0, max(n // 3, 1), n - n // 2)]  # copies
    rows = [(int(i) if i % 7 else int(i) + 1, [float(x) for x in v], None if i % 3 == 0 else "hot" if i % 2 else f"l{i % 5}") for i, v in enumerate(pool)]
    rows += [(None, rows[0][1], "x"), (10_000, [0.0] * 8, None), (10_001, [-0.0001] * 8, "x"), rows[-1]]
    bad = [(-1, None, "x"), (-2, [], "x"), (-3, [None] + [1.0] * 7, "x"), (-4, [float("nan")] + [1.0] * 7, "x"), (-5, [float("-inf")] + [1.0] * 7, "x"), (20_000, [1.0] * 16, "x"), (-6, [1.0] * 9, "x")]
    df = spark.createDataFrame([(i, v, label, 1, "c") for i, v, label in rows + bad], "vec_id bigint, embedding array<float>, label string, error int, code string").repartition(3)
    rows = [(i, np.float32(v).astype(float).tolist(), label) for i, v, label in rows]
    out, books = vector_codes.encode(df, parts=4, entries=entries, rounds=rounds)
    expected, own = brute(rows, 4, entries, rounds)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert books.tolist() == own
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for b in own for c in b for x in c).encode()).hexdigest()


def test_none_kept(spark):
    for rows in ([], [(1, None, 2), (2, [], None)]):
        out, books = vector_codes.encode(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
        assert out.count() == 0 and books.size == 0
        assert out.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_large_numbers_do_not_overflow(spark):
    rows = [(i, [s * 3e38] * 8, 1) for i, s in enumerate((1, -1, 0, 1))]
    out, _ = vector_codes.encode(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), entries=2, rounds=0)
    errors = {r["vec_id"]: r["error"] for r in out.collect()}
    assert errors[0] == errors[1] == errors[3] == 0 < errors[2]


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_annulus_loses_no_entry(data):
    number = st.integers(-(1 << 27), 1 << 27) if data.draw(st.booleans()) else st.integers(-3, 3)
    rows = lambda n: np.array(data.draw(st.lists(st.lists(number, min_size=3, max_size=3), min_size=1, max_size=n)), np.int64)
    entries, x = rows(20), rows(30)
    found, distance = vector_codes.Codebook(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert found.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def test_annulus_measures_few():
    """Of entries whose norms differ, those outside the annulus are never measured."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 4)) * (1 + np.arange(256)[:, None])
    book, measured = vector_codes.Codebook(entries), []
    own = book._distance
    book._distance = lambda x, place: measured.append(len(x)) or own(x, place)
    x = entries[rng.integers(0, 256, 500)] + rng.integers(-5, 5, (500, 4))
    found, _ = book.nearest(x)
    assert (found == ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(measured) < 0.1 * 500 * 256


def test_totals_by_shuffle_equal_totals_by_broadcast(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(40)], "id int, label int")
    totals = rows.groupBy("label").agg(F.count("*").alias("n"))
    one, two = (sorted(map(tuple, sized.with_totals(rows, totals, "label", "n", F.col("id"), broadcast_rows=k).collect())) for k in (100, 0))
    assert one == two and len(one) == 40
