"""Stored roll-ups: who may read them, when they are out of date, and merging equals making them anew."""

import pytest
from conftest import cells
from pyspark.sql import functions as F

from marlstone.plans import rollups
from marlstone.plans.model import CUBES
from marlstone.plans.rollups import Rollups, Stale
from marlstone.plans.semantic import SemanticLayer
from marlstone.sources.bindings import Catalog, Overlay

ALL = [(c.name, name) for c in CUBES.values() for name in c.rollups]
ASK = {"measures": ["loan_agreement.total_loan_contracts"], "dimensions": ["loan_agreement.agreement_status"]}


def test_role_without_a_grant_gets_nothing(spark, sf_dir, tmp_path):
    SemanticLayer(Catalog(spark, sf_dir), str(tmp_path)).materialise("loan_agreement", "credit_risk_rollup")
    assert SemanticLayer(Catalog(spark, sf_dir), str(tmp_path)).load(ASK).inputFiles()[0].find("credit_risk_rollup") > 0
    for role in ("nobody", "authenticated"):
        assert SemanticLayer(Catalog(spark, sf_dir, role), str(tmp_path)).load(ASK).count() == 0


def test_rollup_of_other_tables_is_not_used(spark, sf_dir, tmp_path):
    c = Catalog(spark, sf_dir)
    SemanticLayer(c, str(tmp_path)).materialise("loan_agreement", "credit_risk_rollup")
    for other in (Catalog(spark, sf_dir.replace("0.001", "0.01")), Overlay(c, {"loan_agreement": c.table("loan_agreement").limit(7)}, "few")):
        layer = SemanticLayer(other, str(tmp_path))
        assert not layer.rollups.fresh(other, "loan_agreement", "credit_risk_rollup")
        assert cells(layer.load(ASK).collect(), ["a", "b"]) == cells(SemanticLayer(other).load(ASK).collect(), ["a", "b"])
    unrelated = Overlay(c, {"party_address": c.table("party_address").limit(1)}, "few")
    assert Rollups(str(tmp_path)).fresh(unrelated, "loan_agreement", "credit_risk_rollup")


def _batch(rows, key, column, value, at):
    """Some rows gone, some new under other keys, some changed: changes and the table after them."""
    part = F.pmod(F.xxhash64(F.col(key), F.lit(at)), F.lit(10))
    gone, changed, copied = part == 0, part == 1, part == 2
    other = rows.where(changed).withColumn(column, F.lit(value).cast(rows.schema[column].dataType))
    new = rows.where(copied).withColumn(key, (F.col(key) + 1_000_000 * (at + 1)).cast(rows.schema[key].dataType))
    deleted = rows.where(gone | changed)
    return deleted.withColumn("op", F.lit("delete")).unionByName(other.unionByName(new).withColumn("op", F.lit("insert"))), rows.where(~(gone | changed)).unionByName(other).unionByName(new)


CASES = [
    ("loan_agreement", "credit_risk_rollup", "loan_agreement", "loan_agreement_id", "agreement_status", "DEFAULTED"),
    ("party_role_customer", "customer_risk_rollup", "party_role_customer", "party_role_customer_id", "kyc_status", None),
    ("deposit_account", "account_activity_rollup", "deposit_account", "deposit_account_id", "account_type", "NEW"),
    ("deposit_account", "account_activity_rollup", "deposit_balance", "deposit_account_id", "current_balance", -1),
    ("deposit_balance", "balance_totals_rollup", "deposit_account", "deposit_account_id", "account_status", "FROZEN"),
    ("deposit_balance", "balance_totals_rollup", "deposit_balance", "deposit_balance_id", "current_balance", None),
]


@pytest.mark.parametrize("cube, name, table, key, column, value", CASES)
def test_merging_equals_making_anew(spark, sf_dir, tmp_path, cube, name, table, key, column, value):
    before, store = Catalog(spark, sf_dir), Rollups(str(tmp_path))
    store.store(before, cube, name)
    for at in range(2):
        rows = before.table(table)
        changes, now = _batch(before.table(table), key, column, value, at)
        after = Overlay(before, {table: now}, f"v{at}")
        assert store.merge(cube, name, table, changes, before, after, watermark=at)
        assert not store.merge(cube, name, table, changes, before, after, watermark=at)  # a batch that comes again
        stored, anew = store.read(after, cube, name), SemanticLayer(after).partials(cube, name)
        assert cells(stored.select(*anew.columns).collect(), anew.columns) == cells(anew.collect(), anew.columns)
        assert store.read(before, cube, name) is None
        before = after


def test_a_gap_is_refused(spark, sf_dir, tmp_path):
    before, store = Catalog(spark, sf_dir), Rollups(str(tmp_path))
    changes, now = _batch(before.table("loan_agreement"), "loan_agreement_id", "is_npl", True, 0)
    after = Overlay(before, {"loan_agreement": now}, "v0")
    with pytest.raises(Stale):
        store.merge("loan_agreement", "credit_risk_rollup", "loan_agreement", changes, before, after, 1)
    store.store(before, "loan_agreement", "credit_risk_rollup")
    with pytest.raises(Stale):
        store.merge("loan_agreement", "credit_risk_rollup", "loan_agreement", changes, after, after, 1)
    with pytest.raises(ValueError):
        store.merge("loan_agreement", "credit_risk_rollup", "party", changes, before, after, 1)


def test_stream_of_changes(spark, sf_dir, tmp_path):
    """Batches of a stream are merged as they come; all but two versions go."""
    first, store = Catalog(spark, sf_dir), Rollups(f"{tmp_path}/rollups")
    states, rows = [first], first.table("loan_agreement")
    for at in range(4):
        changes, rows = _batch(rows, "loan_agreement_id", "is_npl", at % 2 == 0, at)
        changes.coalesce(1).write.parquet(f"{tmp_path}/changes/batch={at}")
        states.append(Overlay(first, {"loan_agreement": rows}, f"v{at}"))
    store.store(first, "loan_agreement", "credit_risk_rollup")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/changes")
    write = rollups.sink(store, "loan_agreement", "credit_risk_rollup", "loan_agreement", lambda b: (states[b], states[b + 1]))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    stored, anew = store.read(states[-1], "loan_agreement", "credit_risk_rollup"), SemanticLayer(states[-1]).partials("loan_agreement", "credit_risk_rollup")
    assert cells(stored.select(*anew.columns).collect(), anew.columns) == cells(anew.collect(), anew.columns)
    assert store.manifest(spark, "loan_agreement", "credit_risk_rollup") == {"version": 4, "state": states[-1].state(["loan_agreement"]), "watermark": 3}
    assert sorted(p.name for p in (tmp_path / "rollups/loan_agreement.credit_risk_rollup").glob("data-*")) == ["data-00000003", "data-00000004"]


def test_refresher_stores_what_is_stale(spark, sf_dir, tmp_path):
    c, store = Catalog(spark, sf_dir), Rollups(str(tmp_path))
    write, trigger = rollups.refresher(store, c)
    assert trigger == {"processingTime": "1 hour"}
    write(spark.range(0), 0)
    assert all(store.fresh(c, *each) for each in ALL) and len(ALL) == 4
    write(spark.range(0), 1)
    assert all(store.manifest(spark, *each)["version"] == 0 for each in ALL)
