"""Profiles, assertions and contract checks; all that is asked of all tables is counted in one shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Suite:
    """The assertions of a table: bounds of its row count, columns without nulls, columns of distinct values, allowed values."""

    table: str
    df: DataFrame
    rows_between: tuple[int, int] | None = None
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    allowed: dict[str, tuple] | None = None


def _facts(parts: list[tuple[DataFrame, list[tuple[Column, Column | None]]]]) -> DataFrame:
    """(fact, n, n_distinct): how many rows each fact holds for and how many values they have, over all tables.

    A part is a table and its facts: a condition, and the value that is counted or None. Facts are
    numbered through all parts. Each row says which facts hold for it, with the value as two 64-bit
    hashes; those of all tables are counted in one shuffle of narrow rows that are summed before it,
    and a second one of a few rows counts the values. Facts that hold for no row have no row.
    """
    all_, first = None, 0
    for df, facts in parts:
        nothing = F.lit(0).cast("bigint")
        held = [F.when(holds, F.struct(F.lit(first + i).alias("fact"), (F.xxhash64(v) if v is not None else nothing).alias("h"), (F.xxhash64(F.lit(1), v) if v is not None else nothing).alias("g"))) for i, (holds, v) in enumerate(facts)]
        own = df.select(F.inline(F.array_compact(F.array(*held))))
        all_, first = own if all_ is None else all_.unionByName(own), first + len(facts)
    each = all_.groupBy("fact", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("fact").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


def profile(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table_name, column_name, n_rows, n_values, n_nulls, n_distinct) of columns."""
    return profiles([(table, df, columns)])


def profiles(tables: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(table_name, column_name, n_rows, n_values, n_nulls, n_distinct) of columns of tables (name, rows, columns), all in one go."""
    parts, wanted, at = [], [], 0
    for table, df, columns in tables:
        parts.append((df, [(F.lit(True), None), *((F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")) for c in columns)]))
        wanted += [(at, at + 1 + i, table, c) for i, c in enumerate(columns)]
        at += 1 + len(columns)
    spark = tables[0][1].sparkSession
    facts = _facts(parts)
    asked = spark.createDataFrame(wanted, "rows_of int, fact int, table_name string, column_name string")
    rows = facts.select(F.col("fact").alias("rows_of"), F.col("n").alias("all"))
    found = asked.join(facts, "fact", "left").join(rows, "rows_of", "left")
    n, all_ = F.coalesce("n", F.lit(0)), F.coalesce("all", F.lit(0))
    return found.select("table_name", "column_name", all_.alias("n_rows"), n.alias("n_values"), (all_ - n).alias("n_nulls"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def assertions(df: DataFrame, table: str, rows_between: tuple[int, int] | None = None, not_null: tuple[str, ...] = (), unique: tuple[str, ...] = (), allowed: dict[str, tuple] | None = None) -> DataFrame:
    """(table_name, assertion, column_name, n_failing, passed) of one table."""
    return suites([Suite(table, df, rows_between, not_null, unique, allowed)])


def suites(all_: list[Suite]) -> DataFrame:
    """(table_name, assertion, column_name, n_failing, passed): every assertion of all tables from one shuffle.

    Uniqueness counts values beyond the first of each; nulls are no values. Allowed values pass nulls.
    """
    parts, tests = [], []
    for s in all_:
        facts: list[tuple[Column, Column | None]] = []

        def test(name: str, column: str, holds: Column, value: Column | None = None, least: int = 0, most: int = 0) -> None:
            tests.append((sum(len(f) for _, f in parts) + len(facts), s.table, name, column, least, most))  # noqa: B023
            facts.append((holds, value))  # noqa: B023

        if s.rows_between:
            test("row_count_between", "", F.lit(True), None, *s.rows_between)
        for c in s.not_null:
            test("not_null", c, F.col(c).isNull())
        for c in s.unique:
            test("unique", c, F.col(c).isNotNull(), F.col(c))
        for c, values in (s.allowed or {}).items():
            test("allowed_values", c, ~F.col(c).isin(list(values)))
        parts.append((s.df, facts))
    asked = all_[0].df.sparkSession.createDataFrame(tests, "fact int, table_name string, assertion string, column_name string, least bigint, most bigint")
    n = F.coalesce("n", F.lit(0))
    failing = F.when(F.col("assertion") == "row_count_between", (~n.between(F.col("least"), F.col("most"))).cast("bigint")).when(F.col("assertion") == "unique", n - F.coalesce("n_distinct", F.lit(0))).otherwise(n)
    found = asked.join(_facts([p for p in parts if p[1]]), "fact", "left").withColumn("n_failing", failing.cast("bigint"))
    return found.select("table_name", "assertion", "column_name", "n_failing", (F.col("n_failing") == 0).alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("passed").agg(F.count(F.lit(1)).alias("n_assertions"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(relationship, n_orphans): child rows whose key no parent has."""
    lost = child.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("relationship"), "n_orphans")


def drift(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, column_name, problem): what a contract declares and a schema lacks, and the reverse.

    Both have table_name and column_name. A missing table is one row with a null column.
    """
    tables = actual.select("table_name").distinct()
    missing = declared.select("table_name").distinct().join(tables, "table_name", "left_anti").select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("missing_table").alias("problem"))
    known = declared.join(tables, "table_name", "left_semi")
    phantom = known.join(actual, ["table_name", "column_name"], "left_anti").select("table_name", "column_name", F.lit("phantom_column").alias("problem"))
    undeclared = actual.join(declared.select("table_name").distinct(), "table_name", "left_semi").join(declared, ["table_name", "column_name"], "left_anti").select("table_name", "column_name", F.lit("undeclared_column").alias("problem"))
    return reduce(DataFrame.unionByName, [missing, phantom, undeclared])
