"""Joins with aggregates that are broadcast only when they have been counted and found small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an aggregate that are broadcast at most; a salted shuffle serves beyond.
BROADCAST_ROWS = 100_000
#: Parts into which the rows of one key are dealt in that shuffle.
SALTS = 64


def with_totals(rows: DataFrame, totals: DataFrame, key: str, value: str, spread: Column, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows and the column `value` of the row of totals with the same key, null keys being equal to each other.

    totals has one row a key, and is counted first. spread tells rows of a key apart: beyond
    broadcast_rows it deals them to SALTS parts, each of which gets the total, so that a key with a
    third of all rows isn't one task's. rows has no column by the name of value.
    """
    own, salt = f"__{key}_of_total", "__salt"
    right = totals.select(F.col(key).alias(own), value)
    if totals.count() <= broadcast_rows:
        return rows.join(F.broadcast(right), F.col(key).eqNullSafe(F.col(own)), "left").drop(own)
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(right, F.col(key).eqNullSafe(F.col(own)) & (F.col(salt) == F.col("__part")), "left").drop(own, salt, "__part")
