"""Type-2 versions: half-open validity, as-of reads, set-based updates and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31 23:59:59"


def _open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp_ntz")


def versions(df: DataFrame, key: str, start: str, tiebreak: str) -> DataFrame:
    """df with valid_from, valid_to and is_active: a version ends where its key's next one starts.

    Of rows of a key with the same start only the one with the largest tiebreak is a version.
    """
    latest = df.withColumn("__n", F.row_number().over(Window.partitionBy(key, start).orderBy(F.col(tiebreak).desc()))).where("__n = 1").drop("__n")
    ends = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    out = latest.withColumns({"valid_from": F.col(start), "valid_to": F.coalesce(ends, _open_end())})
    return out.withColumn("is_active", F.col("valid_to") == _open_end())


def as_of(history: DataFrame, at: str) -> DataFrame:
    """Versions that are valid at an instant."""
    t = F.lit(at).cast("timestamp_ntz")
    return history.where((F.col("valid_from") <= t) & (t < F.col("valid_to")))


def overlaps(df: DataFrame, key: str, start: str, end: str, tiebreak: str | None = None) -> DataFrame:
    """Rows whose interval begins before the end of any earlier one of their key: one sort instead of a self-join.

    reaches is the latest end among the earlier rows, so intervals that aren't neighbours count too.
    """
    before = Window.partitionBy(key).orderBy(start, end, *([tiebreak] if tiebreak else [])).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reaches", F.max(end).over(before)).where(F.col("reaches") > F.col(start))


#: Stretches of time into which the rows of a key are dealt for an as-of join.
STRETCHES = 64


def as_of_join(rows: DataFrame, history: DataFrame, key: str, at: str, carried: list[str], stretches: int = STRETCHES) -> DataFrame:
    """rows with the carried columns of the version of their key that is valid at their own instant, else nulls.

    Rows and versions are sorted together by key and time, and the last version before each row is
    handed down, so a key's rows are never multiplied by its versions. Time is cut into stretches
    with about as many rows each, and a task gets a key's rows of one stretch: a key that has all
    rows is split. Each stretch begins with the last version that the key had before it, which
    comes from a row for each key and stretch. rows may not have null keys; of several versions
    with one start any may be handed down.
    """
    version = F.struct(F.col("valid_to").cast("timestamp_ntz").alias("until"), *carried)
    none = F.lit(None).cast(history.select(version.alias("v")).schema["v"].dataType)
    marks = history.select(F.col(key).alias("__key"), F.col("valid_from").cast("timestamp_ntz").alias("__at"), F.lit(0).alias("__kind"), version.alias("__v"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("__row"))
    own = rows.select(F.col(key).alias("__key"), F.col(at).cast("timestamp_ntz").alias("__at"), F.lit(1).alias("__kind"), none.alias("__v"), F.struct("*").alias("__row"))
    times = own.select("__at").unionByName(marks.select("__at")).select(F.col("__at").cast("timestamp").cast("double").alias("t"))
    cuts = times.agg(F.percentile_approx("t", [i / stretches for i in range(1, stretches)], 10 * stretches)).first()[0] if stretches > 1 else None
    edges = sorted(set(cuts or ()))
    t = F.col("__at").cast("timestamp").cast("double")
    stretch = F.size(F.filter(F.lit(edges), lambda e: e <= t)) if edges else F.lit(0)
    both = marks.unionByName(own).withColumn("__part", F.when(F.col("__at").isNull(), -1).otherwise(stretch))

    # A null end sorts before all others, so the greatest struct is that of the latest start.
    last = both.groupBy("__key", "__part").agg(F.max(F.when(F.col("__kind") == 0, F.struct("__at", "__v"))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    opening = last.withColumn("__before", before).where("__before is not null").select("__key", "__part", F.col("__before.__at").alias("__at"), F.lit(0).alias("__kind"), F.col("__before.__v").alias("__v"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"))
    along = Window.partitionBy("__key", "__part").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.unionByName(opening).withColumn("__v", F.last("__v", ignorenulls=True).over(along)).where("__kind = 1")
    valid = F.col("__v.until") > F.col("__at")
    return found.select("__row.*", *[F.when(valid, F.col(f"__v.{c}")).alias(f"v_{c}") for c in carried])


def disordered(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col(start) >= F.col(end))


def several_active(df: DataFrame, key: str, active: str = "is_active") -> DataFrame:
    return df.where(active).groupBy(key).agg(F.count(F.lit(1)).alias("n_active")).where("n_active > 1")


def apply_changes(history: DataFrame, changes: DataFrame, key: str, cutover: str | None = None, at_col: str = "cutover", strict: bool = False) -> DataFrame:
    """The history after changes (rows of a key, with the columns that change).

    All changes take effect at cutover, or each at its own at_col. The active version of a changed
    key ends at the first cut-over and a version starts at each, with the changed columns and all
    others carried over; a version ends where the next starts. Of changes of a key at one instant
    the one with the greatest columns counts. Changes to unknown columns raise. Changes of keys
    without an active version, or not after its start, have no effect; with strict they raise.
    A column updated_at, where the history has one, gets the cut-over of closed and new versions.
    """
    changed = [c for c in changes.columns if c not in (key, at_col)]
    unknown = sorted(set(changed) - set(history.columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    at = F.lit(cutover).cast("timestamp_ntz") if cutover is not None else F.col(at_col).cast("timestamp_ntz")
    asked = changes.select(F.col(key), at.alias("__at"), F.struct(*changed).alias("__new"))
    active = history.where("is_active")
    if strict:
        lost = asked.join(active.select(key, F.col("valid_from").alias("__from")), key, "left").where(F.col("__from").isNull() | (F.col("__at") <= F.col("__from")))
        if not lost.isEmpty():
            raise ValueError("changes of keys without an active version, or not after its start")
    once = asked.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__at").orderBy(F.col("__new").desc()))).where("__n = 1").drop("__n")
    due = active.join(once, key).where(F.col("__at") > F.col("valid_from"))
    in_order = Window.partitionBy(key).orderBy("__at")
    due = due.withColumns({"__next": F.lead("__at").over(in_order), "__n": F.row_number().over(in_order)})
    fresh = {c: F.col(f"__new.{c}") for c in changed} | {"valid_from": F.col("__at"), "valid_to": F.coalesce("__next", _open_end()), "is_active": F.col("__next").isNull(), "updated_at": F.col("__at")}
    added = due.select(*[fresh.get(c, F.col(c)).cast(history.schema[c].dataType).alias(c) for c in history.columns])
    ends = due.where("__n = 1").select(F.col(key), F.col("__at"))
    hit = F.col("__at").isNotNull() & F.col("is_active")
    closed = {"valid_to": F.col("__at"), "is_active": F.lit(False), "updated_at": F.col("__at")}
    kept = history.join(ends, key, "left").select(*[(F.when(hit, closed[c].cast(history.schema[c].dataType)).otherwise(F.col(c)) if c in closed else F.col(c)).alias(c) for c in history.columns])
    return kept.unionByName(added)
