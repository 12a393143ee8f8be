"""Counts of all tables in one shuffle, and to-one joins that hold what they promise."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import catalog as catalogs
from marlstone.operators import quality
from marlstone.plans.semantic import SemanticLayer
from marlstone.sources.bindings import Catalog, Overlay


def test_counts_of_odd_values(spark):
    rows = [(1, "a", 1.0), (1, "b", None), (None, "", float("nan")), (2, None, float("nan")), (3, "a", -0.0), (4, "a", 0.0)]
    df = spark.createDataFrame(rows, "k int, `odd name` string, v double")
    found = {r["column_name"]: tuple(r)[2:] for r in quality.profile(df, "t", ["k", "odd name", "v"]).collect()}
    assert found == {"k": (6, 5, 1, 4), "odd name": (6, 5, 1, 3), "v": (6, 5, 1, 3)}
    empty = {r["column_name"]: tuple(r)[2:] for r in quality.profile(df.where("k = 9"), "t", ["k"]).collect()}
    assert empty == {"k": (0, 0, 0, 0)}


def test_facts_of_empty_and_full_tables(spark):
    full, empty = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, s string"), spark.createDataFrame([], "k int, s string")
    found = quality.suites([quality.Suite(t, df, (1, 9), ("k",), ("k",), {"s": ("x", "y")}) for t, df in (("full", full), ("empty", empty))])
    got = {(r["table_name"], r["assertion"]): (r["n_failing"], r["passed"]) for r in found.collect()}
    assert got == {("full", a): (n, n == 0) for a, n in (("row_count_between", 0), ("not_null", 1), ("unique", 1), ("allowed_values", 1))} | {("empty", a): (n, n == 0) for a, n in (("row_count_between", 1), ("not_null", 0), ("unique", 0), ("allowed_values", 0))}


def test_all_suites_share_one_shuffle(spark, sf_dir):
    plan = catalogs.all_suites(Catalog(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.splitlines() if "Exchange" in line and ", h#" in line]
    assert len(hashed) == 1 and "Expand" not in plan


BALANCE = {"measures": ["deposit_account.total_available_balance"], "dimensions": ["deposit_account.account_type"]}


def test_second_active_balance_is_never_added(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    balances = c.table("deposit_balance")
    twice = Overlay(c, {"deposit_balance": balances.unionByName(balances.where("deposit_account_id = 1"))}, "twice")
    with pytest.raises(Exception, match="deposit_balance.*more than one row"):
        SemanticLayer(twice).load(BALANCE).collect()
    closed = balances.where("deposit_account_id = 1").withColumn("md_is_active", F.lit(False))
    history = Overlay(c, {"deposit_balance": balances.unionByName(closed)}, "history")
    assert sorted(SemanticLayer(history).load(BALANCE).collect()) == sorted(SemanticLayer(c).load(BALANCE).collect())
