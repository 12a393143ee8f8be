"""Histories kept by change logs equal all changes applied at once, however they come."""

import datetime
import os
import random

import pytest
from conftest import cells
from pyspark.sql import functions as F

from marlstone.operators import temporal
from marlstone.streaming import versions
from marlstone.streaming.versions import VersionLog

START = datetime.datetime(2020, 1, 1)
SCHEMA = "k int, v string, w int, cutover timestamp_ntz"


def _history(spark, n=40):
    rows = [(k, f"v{k}", k, k, START) for k in range(n)]
    return temporal.versions(spark.createDataFrame(rows, "k int, v string, w int, id int, start timestamp_ntz"), "k", "start", "id").drop("start")


def _changes(rng, n, days):
    return [(rng.randrange(50), rng.choice(["a", "b", None]), rng.randrange(5), START + datetime.timedelta(days=rng.choice(days))) for _ in range(n)]


def _same(a, b):
    assert cells(a.select(*sorted(b.columns)).collect(), sorted(b.columns)) == cells(b.select(*sorted(b.columns)).collect(), sorted(b.columns))


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_late_and_repeated_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    history, log = _history(spark), VersionLog(spark, str(tmp_path), "k", buckets=4)
    log.create(history)
    early, later = [_changes(rng, 15, range(1, 30)) for _ in range(3)], [_changes(rng, 15, range(20, 60)) for _ in range(3)]
    batches = early + later
    rng.shuffle(batches)
    every = spark.createDataFrame(sum(batches, []), SCHEMA)
    for b, rows in enumerate(batches[:4]):
        log.append(spark.createDataFrame(rows, SCHEMA), b)
    log.append(spark.createDataFrame(batches[1], SCHEMA), 1)  # a batch that comes again
    _same(log.read(), temporal.apply_changes(history, spark.createDataFrame(sum(batches[:4], []), SCHEMA), "k"))
    cut = START + datetime.timedelta(hours=12)  # before all changes: nothing folds, all stay beside the base
    assert log.compact(str(cut)) == []
    for b, rows in enumerate(batches[4:], 4):
        log.append(spark.createDataFrame(rows, SCHEMA), b)
    log.append(spark.createDataFrame(batches[0], SCHEMA), 0)  # folded: ignored
    _same(log.read(), temporal.apply_changes(history, every, "k"))
    log.compact(str(START + datetime.timedelta(days=25)))
    _same(log.read(), temporal.apply_changes(history, every, "k"))
    log.append(spark.createDataFrame([(1, "late", 0, START + datetime.timedelta(days=3)), (None, "x", 0, START), (2, "on time", 0, START + datetime.timedelta(days=90))], SCHEMA), 9)
    assert sorted(r["v"] for r in log.late().collect()) == ["late", "x"]
    on_time = spark.createDataFrame([(2, "on time", 0, START + datetime.timedelta(days=90))], SCHEMA)
    _same(log.read(), temporal.apply_changes(history, every.unionByName(on_time), "k"))
    log.compact()
    log.vacuum()
    _same(log.read(), temporal.apply_changes(history, every.unionByName(on_time), "k"))
    assert sorted(os.listdir(tmp_path / "log")) and len(log.manifests.numbers()) == 2


def _size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_bytes_written_grow_with_the_batch(spark, tmp_path):
    sizes = {}
    for n in (200, 20_000):
        log = VersionLog(spark, f"{tmp_path}/{n}", "k", buckets=4)
        log.create(spark.range(n).select(F.col("id").cast("int").alias("k"), F.xxhash64("id").cast("string").alias("v"), F.lit(1).alias("w"), F.lit(START).cast("timestamp_ntz").alias("valid_from"), F.lit(temporal.OPEN_END).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_active")))
        before = _size(f"{tmp_path}/{n}")
        log.append(spark.createDataFrame([(1, "x", 2, START + datetime.timedelta(days=1))], SCHEMA), 0)
        sizes[n] = (before, _size(f"{tmp_path}/{n}") - before)
        assert log.compact() == [log.read().where("k = 1").select(log._bucket().alias("b")).first()["b"]]  # one bucket is rewritten
        assert _size(f"{tmp_path}/{n}/base-1") < 0.5 * _size(f"{tmp_path}/{n}/base-0")
    assert sizes[20_000][0] > 10 * sizes[200][0] and sizes[20_000][1] < 1.5 * sizes[200][1]


def test_sink_folds_as_it_goes(spark, tmp_path):
    rng = random.Random(5)
    history, log = _history(spark), VersionLog(spark, f"{tmp_path}/log", "k", buckets=4)
    log.create(history)
    batches = [_changes(rng, 12, range(10 * b + 1, 10 * b + 12)) for b in range(4)]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(versions.sink(log, "12 days", 0.3)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    _same(log.read(), temporal.apply_changes(history, spark.createDataFrame(sum(batches, []), SCHEMA), "k"))
    assert log.manifests.last()["generation"] >= 1 and log.late() is None
