"""Structured Streaming forms: windowed aggregates with watermarks, quantile sketches, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.temporal import apply_changes
from marlstone.sources.manifest import Manifests


def event_stream(spark: SparkSession, folder: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def sliding_rate(events: DataFrame, time: str = "ts", kind: str = "event_type", bad: str = "error", length: str = "15 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, n_events, n_bad, bad_ratio) of sliding windows; later rows than `late` are dropped by the watermark."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    counts = timed.groupBy(F.window("__t", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col(kind) == bad).alias("n_bad"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n_events", "n_bad", F.round(F.col("n_bad").cast("double") / F.col("n_events"), 4).alias("bad_ratio"))


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, session_start, n_events) of runs of a user's events with no gap as long as `gap`."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.session_window("__t", gap).alias("w"), F.col(user).alias("user_id")).agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n_events")


def scd2_sink(base: str, key: str):
    """A foreachBatch function: each batch of changes (key, cutover, changed columns) makes a new state of the history, every change at its own cut-over.

    States are written whole under base/state=N, so a batch that is retried overwrites its own
    state and readers never see a half-written one; the last two stay. That suits small histories:
    streaming.versions writes what a batch changes alone.
    """

    def write(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        before = spark.read.parquet(f"{base}/state={batch - 1}" if batch else f"{base}/initial")
        apply_changes(before, changes, key).write.mode("overwrite").parquet(f"{base}/state={batch}")
        Manifests(spark, base).delete(f"{base}/state={batch - 2}")

    return write


def latency_quantile(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", q: float = 0.95, length: str = "15 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n, quantile) of sliding windows; the quantile is interpolated between exact ranks."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    found = timed.groupBy(F.window("__t", length, slide).alias("w"), F.col(kind).alias("kind")).agg(F.count(value).alias("n"), F.percentile(value, F.lit(q)).alias("quantile"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "kind", "n", "quantile")


#: Items of a quantile sketch's levels: its size is bounded by them, and so is the error of its ranks.
SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """The share of all values by which the rank of an estimate may be off, with 99 percent confidence (the sketches' published bound)."""
    return 2.446 / k**0.9433


def quantile_sketches(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", length: str = "15 minutes", slide: str = "5 minutes", late: str = "10 minutes", k: int = SKETCH_K) -> DataFrame:
    """(window_start, kind, n, sketch) of sliding windows: a KLL sketch of the values instead of the values.

    As a partial aggregate and as a stream's state, a group is one sketch of bounded size however
    many events it has. Sketches of several windows or tables can be merged. Null values and NaN
    aren't counted; a group without values has a null sketch.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    found = timed.groupBy(F.window("__t", length, slide).alias("w"), F.col(kind).alias("kind")).agg(F.count(number).alias("n"), F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "kind", "n", F.when(F.col("n") > 0, F.col("sketch")).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str, k: int = SKETCH_K) -> DataFrame:
    """(by, n, sketch): sketches merged over all that isn't in by."""
    return sketches.where("sketch is not null").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_quantile(sketch, q: float):
    """The value at a rank of q of all; its true rank is within rank_error() of q."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def held(rates: DataFrame, threshold: float, times: int, rate: str = "bad_ratio") -> DataFrame:
    """Windows with which the rate has been over the threshold `times` windows running: an alert that holds."""
    from pyspark.sql import Window

    running = Window.orderBy("window_start").rowsBetween(-(times - 1), 0)  # windows of one series: one row for each slide
    over = rates.withColumn("__over", F.sum((F.col(rate) > threshold).cast("int")).over(running))
    return over.where(F.col("__over") == times).drop("__over")


def refresh(build, path: str, every: str = "1 hour"):
    """A foreachBatch function and trigger that write build() anew to path whenever a tick of `every` comes."""

    def write(_: DataFrame, batch: int) -> None:
        build().write.mode("overwrite").parquet(path)

    return write, {"processingTime": every}
