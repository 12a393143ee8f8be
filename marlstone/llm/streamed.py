"""The greatest id of each key's rows, without ever gathering a key in one task.

Partial counts by key and salt shrink hot keys before any shuffle. What repeats becomes a mark for
each salt it has; marks and rows are range-partitioned together and sorted, and a running window
hands a mark's value down the rows of its key and salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt, so that no task gets a hot key whole.
SALTS = 64


def with_top(rows: DataFrame, keys: list[str], id_col: str, least: int, counted: DataFrame | None = None) -> DataFrame:
    """rows and `top`: the greatest id among the counted rows of its key, where there are least of them or more, else null.

    counted (rows by default) has keys and id_col, a row for each time a key counts. No other
    column of rows may be named top, n, salt or salts; keys and ids aren't null. Rows of equal id
    and key count each for themselves.
    """
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt")
    counted = (rows if counted is None else counted).select(*keys, id_col, salt)
    parts = counted.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("n"), F.max(id_col).alias("top"))
    common = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.collect_list("salt").alias("salts")).where(F.col("n") >= least)
    rest = [c for c in rows.columns if c not in keys]
    marks = common.select(*keys, F.explode("salts").alias("salt"), "top", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest])
    own = rows.select(*keys, salt, F.lit(None).cast(rows.schema[id_col].dataType).alias("top"), *rest)
    stream = marks.unionByName(own).repartitionByRange(*keys, "salt")
    along = Window.partitionBy(*keys, "salt").orderBy(F.col(id_col).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stream.withColumn("top", F.first("top").over(along)).where(F.col(id_col).isNotNull()).drop("salt")
