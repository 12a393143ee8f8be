import pytest

from marlstone.plans.model import CUBES
from marlstone.plans.semantic import AccessDenied, AmbiguousPath, SemanticLayer, authorise, path
from marlstone.sources.bindings import Catalog


def test_model_size():
    assert len(CUBES) == 19
    assert sum(len(c.measures) for c in CUBES.values()) == 57
    assert sum(len(c.joins) for c in CUBES.values()) == 25
    assert sum(len(c.rollups) for c in CUBES.values()) == 4


def test_masked_and_privileged_members():
    with pytest.raises(AccessDenied):
        authorise({"dimensions": ["party_individual.gender"]}, "privileged")
    with pytest.raises(AccessDenied):
        authorise({"measures": ["customer_360.high_aml_risk_count"]}, None)
    with pytest.raises(AccessDenied):
        authorise({"measures": ["loan_agreement.total_loan_contracts"], "filters": [{"or": [{"member": "party_role_customer.aml_risk_rating", "operator": "set"}]}]}, "analyst")
    authorise({"measures": ["customer_360.high_aml_risk_count"]}, "privileged")


def test_paths():
    assert path("loan_collateral", "party_role_customer") == [("loan_collateral", "loan_agreement"), ("loan_agreement", "party_role_customer")]
    with pytest.raises(AmbiguousPath):
        path("party_role_customer", "ref_country")


def test_rollup_matching():
    q = {"measures": ["loan_agreement.total_loan_contracts"], "dimensions": ["loan_agreement.is_npl"]}
    assert SemanticLayer.matching_rollup(q) == ("loan_agreement", "credit_risk_rollup")
    assert SemanticLayer.matching_rollup(q | {"dimensions": ["loan_agreement.term_months"]}) is None
    assert SemanticLayer.matching_rollup({"measures": ["loan_agreement.npl_default_ratio"]}) is None


def test_no_measure_is_multiplied_by_another_branch(spark, sf_dir):
    layer = SemanticLayer(Catalog(spark, sf_dir))
    alone = layer.load({"measures": ["deposit_account.total_available_balance"]}).first()[0]
    both = layer.load({"measures": ["deposit_account.total_available_balance", "loan_agreement.total_principal_exposure"]}).first()[0]
    assert alone == both


def test_ratio_of_nothing_is_null(spark, sf_dir):
    row = SemanticLayer(Catalog(spark, sf_dir)).load({"measures": ["loan_agreement.npl_default_ratio"], "filters": [{"member": "loan_agreement.agreement_status", "operator": "equals", "values": ["NONE"]}]}).first()
    assert row[0] is None


def test_roles_see_their_schemas(spark, sf_dir):
    assert Catalog(spark, sf_dir, "anon").table("party").count() == 0
    assert Catalog(spark, sf_dir, "authenticated").table("ref_country").count() > 0
    assert Catalog(spark, sf_dir, "authenticated").table("party").count() == 0


def test_many_rows_alike_are_joined_once(spark, sf_dir):
    """Rows on the far side of a to-many edge don't multiply the owner's, and no row is kept to be told from its copies."""
    layer = SemanticLayer(Catalog(spark, sf_dir))
    df, many = layer._joined("loan_repayment_schedule", {("loan_collateral", "collateral_status")}, frozenset(["loan_collateral__collateral_status"]))
    table = lambda name, *cols: layer.catalog.table(name).select(*cols)
    rows = table("loan_repayment_schedule", "loan_agreement_id").selectExpr("*", "monotonically_increasing_id() AS n").join(table("loan_agreement", "loan_agreement_id").distinct(), "loan_agreement_id", "left_semi")
    every = rows.join(table("loan_collateral", "loan_agreement_id", "collateral_status"), "loan_agreement_id", "left")
    assert not many and df.count() == every.select("n", "collateral_status").distinct().count() < every.count()
    assert layer._joined("loan_repayment_schedule", {("loan_collateral", "collateral_status"), ("loan_collateral", "collateral_type")}, frozenset(["loan_collateral__collateral_status"]))[1]
