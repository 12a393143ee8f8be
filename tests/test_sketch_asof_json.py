"""Quantile sketches, as-of joins split by time, and JSON containment, against plain Python."""

import bisect
import datetime
import json as plain
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import json
from marlstone.operators import temporal
from marlstone.streaming import windows


@pytest.mark.parametrize("shape", ["uniform", "skewed", "ties"])
def test_sketch_ranks(spark, shape):
    draw = {"uniform": F.rand(1), "skewed": F.pow(F.rand(2), 8), "ties": F.floor(F.rand(3) * 7).cast("double")}[shape]
    events = spark.range(60_000).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id") % 48)).alias("ts"), (F.col("id") % 2).cast("string").alias("event_type"), draw.alias("value")).persist()
    found = windows.merged_sketches(windows.quantile_sketches(events, length="1 day", slide="1 day"), "kind")
    for r in found.select("kind", "n", *[windows.sketched_quantile(F.col("sketch"), q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)]).collect():
        values = sorted(x[0] for x in events.where(F.col("event_type") == r["kind"]).select("value").collect())
        assert r["n"] == len(values) == 30_000
        for q in (0.05, 0.5, 0.95):
            low, high = bisect.bisect_left(values, r[f"q{int(q * 100)}"]), bisect.bisect_right(values, r[f"q{int(q * 100)}"])
            assert low / len(values) - 2 * windows.rank_error() <= q <= high / len(values) + 2 * windows.rank_error()
    events.unpersist()


def test_sketches_stay_small(spark):
    sizes = [spark.range(n).select(F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("k").alias("event_type"), F.xxhash64("id").cast("double").alias("value")) for n in (20_000, 400_000)]
    small, large = (windows.quantile_sketches(e).agg(F.max(F.octet_length("sketch"))).first()[0] for e in sizes)
    assert large < 1.5 * small < 60_000


def test_sketch_state_in_a_stream(spark, tmp_path):
    """The state of a stream is a sketch for each group, and its answer is that of the batch."""
    start = datetime.datetime(2024, 1, 1)
    for b in range(3):
        spark.range(5000).select((F.lit(start).cast("timestamp") + F.make_dt_interval(days=F.lit(b))).alias("ts"), F.lit("k").alias("event_type"), F.rand(b).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    windows.quantile_sketches(stream, length="1 day", slide="1 day", late="1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/out")
    assert done.agg(F.sum("n")).first()[0] in (5000, 10_000)  # days that the watermark has passed
    assert windows.merged_sketches(done, "kind").select(F.abs(windows.sketched_quantile(F.col("sketch"), 0.5) - 0.5)).first()[0] < 0.03


@pytest.mark.parametrize("stretches", [1, 2, 16])
def test_as_of_join_over_stretches(spark, stretches):
    rng = random.Random(stretches)
    at = lambda d: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=d)
    starts = {k: sorted(rng.sample(range(1000), n)) for k, n in ((1, 40), (2, 1), (3, 0), (4, 3))}
    history = [(k, f"{k}-{s}", at(s), at(e)) for k, all_ in starts.items() for s, e in zip(all_, [*all_[1:], 900 if k == 2 and all_[0] < 900 else 10**5])]
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, 5]), i, at(rng.randrange(1100))) for i in range(400)] + [(1, 1000, None), (1, 1001, at(starts[1][3]))]
    h = spark.createDataFrame(history, "k int, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = temporal.as_of_join(spark.createDataFrame(rows, "k int, id int, t timestamp_ntz"), h, "k", "t", ["v"], stretches).collect()
    expected = {i: next((v for kk, v, a, b in history if kk == k and t is not None and a <= t < b), None) for k, i, t in rows}
    assert {r["id"]: r["v_v"] for r in got} == expected and len(got) == len(rows)


def test_one_key_is_split(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), "id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).cast("timestamp_ntz").alias("t"))
    history = rows.where("id % 1000 = 0").select("k", F.col("id").alias("v"), F.col("t").alias("valid_from"), F.lit("2099-01-01").cast("timestamp_ntz").alias("valid_to"))
    found = temporal.as_of_join(rows, history, "k", "t", ["v"])
    assert found.where("v_v <> id - id % 1000 or v_v is null").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in plan and "__part" in plan.split("Window")[1]


def brute(value, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(value, dict) and all(k in value and brute(value[k], v, False) for k, v in pattern.items())
    if isinstance(pattern, list):
        return isinstance(value, list) and all(any(brute(x, p, False) for x in value) for p in pattern)
    if top and isinstance(value, list):
        return any(brute(x, pattern, False) for x in value if not isinstance(x, (list, dict)))
    return type(value) is type(pattern) and value == pattern or (isinstance(value, (int, float)) and isinstance(pattern, (int, float)) and not isinstance(value, bool) and not isinstance(pattern, bool) and value == pattern)


_JSON = st.recursive(st.none() | st.booleans() | st.integers(-2, 2) | st.sampled_from([0.5, 1.0]) | st.sampled_from(["", "a", "it's", "é", "1", "x.y"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b c", "it's", "x.y", "é", "'\""]), x, max_size=3), max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(_JSON, min_size=1, max_size=12), _JSON)
def test_containment(spark, values, pattern):
    values = values + [pattern, [pattern], {"a": pattern}]
    df = spark.createDataFrame([(i, plain.dumps(v)) for i, v in enumerate(values)] + [(-1, None), (-2, "{not json")], "id int, j string")
    got = {r["id"]: r["c"] for r in df.select("id", json.contains_text(F.col("j"), plain.dumps(pattern)).alias("c")).collect()}
    assert got == {i: brute(v, pattern) for i, v in enumerate(values)} | {-1: False, -2: False}
