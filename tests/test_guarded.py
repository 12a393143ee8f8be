import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.plans import guarded
from marlstone.sources import documents
from marlstone.sources.bindings import Catalog

TURTLE = """
@prefix fin: <http://x#> .
# a comment
fin:Individual a owl:Class ;
    rdfs:subClassOf fin:Party ;
    rdfs:label "Individual Person"@en ;
    rdfs:isDefinedBy bian:Role, fibo:Person .
fin:isNpl a owl:DatatypeProperty ; rdfs:range xsd:boolean .
"""
DDL = """CREATE TABLE financial.party (
    party_id UUID PRIMARY KEY,
    party_type VARCHAR(20) NOT NULL CHECK (party_type IN ('INDIVIDUAL', 'ORGANIZATION')),
    CONSTRAINT c CHECK (party_id IS NOT NULL)
);"""


def test_only_reading_and_masked_by_origin(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    for sql in ("DELETE FROM party", "SELECT 1; SELECT 2", "CREATE TABLE x AS SELECT 1", "INSERT INTO party SELECT 1", "SHOW TABLES"):
        with pytest.raises(guarded.Rejected):
            guarded.query(c, sql)
    answer = guarded.query(c, "SELECT party_id, upper(last_name) AS nick, concat(gender, '!') AS g2, md_is_active FROM (SELECT * FROM party_individual) p ORDER BY party_id", cap=5)
    rows = answer.rows.collect()
    assert answer.truncated and len(rows) == 5
    assert all(r["nick"] == "[REDACTED]" and r["g2"] in ("[REDACTED]", None) and isinstance(r["md_is_active"], bool) for r in rows)
    assert not guarded.query(c, "WITH a AS (SELECT count(*) AS n FROM party) SELECT n FROM a").truncated


LEAKS = (
    "SELECT customer_segment AS x FROM party_role_customer UNION ALL SELECT last_name FROM party_individual",
    "SELECT x FROM party_individual LATERAL VIEW explode(array(last_name)) t AS x",
    "SELECT explode(array(last_name)) AS x FROM party_individual",
    "SELECT x FROM (SELECT explode(map('x', last_name)) AS (k, x) FROM party_individual)",
    "SELECT (SELECT max(last_name) FROM party_individual) AS x",
    "WITH a AS (SELECT party_id, last_name AS z FROM party_individual) SELECT p.z AS x FROM a p JOIN a q ON p.party_id = q.party_id",
    "SELECT v AS x FROM (SELECT first_name, last_name FROM party_individual) UNPIVOT (v FOR k IN (first_name, last_name))",
    "SELECT customer_number AS x FROM party_role_customer INTERSECT SELECT last_name FROM party_individual",
    "SELECT coalesce(last_name, 'n') AS x FROM party_individual GROUP BY ROLLUP(last_name)",
    "WITH RECURSIVE r(y, n) AS (SELECT last_name, 1 FROM party_individual UNION ALL SELECT y, n + 1 FROM r WHERE n < 2) SELECT y AS x FROM r",
    "SELECT x FROM party p, LATERAL (SELECT last_name AS x FROM party_individual i WHERE i.party_id = p.party_id)",
    "SELECT cast(party_type IN (SELECT last_name FROM party_individual) AS string) AS x FROM party",
    "SELECT F AS x FROM (SELECT party_id, last_name, md_is_active FROM party_individual) PIVOT (max(last_name) FOR md_is_active IN (true AS F, false AS G))",
    "SELECT b AS x FROM (SELECT inline(array(struct(1 AS a, last_name AS b))) FROM party_individual)",
    "SELECT get_json_object(j, '$.l') AS x FROM (SELECT to_json(struct(last_name AS l)) AS j FROM party_individual)",
    "SELECT element_at(transform(array(1), i -> last_name), 1) AS x FROM party_individual",
    "SELECT first_value(last_name) OVER (PARTITION BY party_id ORDER BY party_id) AS x FROM party_individual",
)


@pytest.mark.parametrize("sql", LEAKS)
def test_no_way_round_the_mask(spark, sf_dir, sql):
    rows = guarded.query(Catalog(spark, sf_dir, "tools"), sql, cap=5000).rows.collect()
    assert rows and {r["x"] for r in rows} <= {"[REDACTED]", None}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT party_id FROM party_individual WHERE last_name = 'a'",
        "SELECT party_id FROM party_individual ORDER BY last_name",
        "SELECT party_id, count(*) AS n FROM party_individual GROUP BY party_id HAVING max(last_name) > 'a'",
        "SELECT p.party_id FROM party_individual p JOIN party_individual q ON p.last_name = q.first_name",
        "SELECT party_id FROM party p WHERE EXISTS (SELECT 1 FROM party_individual i WHERE i.party_id = p.party_id AND i.last_name = 'q')",
        "WITH a AS (SELECT party_id, upper(last_name) AS z FROM party_individual) SELECT party_id FROM a WHERE z LIKE 'C%'",
    ],
)
def test_personal_data_chooses_no_rows(spark, sf_dir, sql):
    with pytest.raises(guarded.Rejected):
        guarded.query(Catalog(spark, sf_dir, "tools"), sql)


def test_clean_columns_stay(spark, sf_dir):
    c = Catalog(spark, sf_dir, "tools")
    answer = guarded.query(c, "SELECT p.party_id, p.party_type, i.last_name, count(*) OVER () AS n, NULL AS z, p.party_type FROM party p JOIN party_individual i ON p.party_id = i.party_id WHERE i.last_name IS NOT NULL", None)
    row = answer.rows.first()
    assert answer.rows.columns == ["party_id", "party_type", "last_name", "n", "z", "party_type"]
    assert row[1] == "INDIVIDUAL" and row[2] == "[REDACTED]" and row[3] > 0 and row[4] is None and row[5] == "INDIVIDUAL"
    answer.drop()
    with pytest.raises(Exception, match="(?i)exist|not.found"):
        spark.read.parquet(answer.path)


#: Ways to hand (k, a, b) on: statements over {t} whose columns are again k, a, b made from the same.
HANDS_ON = (
    "SELECT k, upper(a) AS a, b || '!' AS b FROM ({t})",
    "SELECT k, a, b FROM ({t}) UNION ALL SELECT k, b, b FROM ({t})",
    "SELECT k, x AS a, b FROM ({t}) LATERAL VIEW explode(array(a, 'z')) e AS x",
    "SELECT k, max(a) AS a, max(b) AS b FROM ({t}) GROUP BY k",
    "SELECT k, (SELECT max(a) FROM ({t})) AS a, b FROM ({t})",
    "WITH c AS ({t}) SELECT l.k, r.a, l.b FROM c l JOIN c r ON l.k = r.k",
    "SELECT k, CASE WHEN a = 'q' THEN 'x' ELSE 'y' END AS a, b FROM ({t})",
    "SELECT k, a, b FROM ({t}) EXCEPT SELECT 1, 'a', 'b'",
    "SELECT k, s.p AS a, s.q AS b FROM (SELECT k, struct(a AS p, b AS q) AS s FROM ({t}))",
    "SELECT k, a, b FROM ({t}) WHERE k % 2 = 0 ORDER BY k",
)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(HANDS_ON), max_size=3), st.sampled_from(["last_name", "cast(party_id AS string)"]), st.sampled_from(["gender", "cast(citizenship_country_code AS string)"]))
def test_origin_of_generated_statements(spark, sf_dir, steps, a, b):
    """A column is masked just when it is made from a personal one, whatever lies between; a struct counts as one value."""
    sql = f"SELECT party_id AS k, {a} AS a, {b} AS b FROM party_individual"
    personal_a, personal_b = a == "last_name", b == "gender"
    for step in steps:
        sql = step.replace("{t}", sql)
        personal_a |= "UNION ALL" in step and personal_b
        if "struct" in step:
            personal_a = personal_b = personal_a or personal_b
    rows = guarded.query(Catalog(spark, sf_dir, "tools"), sql, cap=20).rows.collect()
    shown = lambda c: {r[c] for r in rows} - {None, "[REDACTED]"}
    assert rows and bool(shown("a")) != personal_a and bool(shown("b")) != personal_b and isinstance(rows[0]["k"], int)


def test_the_result_itself_is_limited(spark, sf_dir):
    slow = "SELECT count(*) AS n FROM loan_repayment_schedule a, loan_repayment_schedule b, loan_repayment_schedule c WHERE a.total_due + b.total_due + c.total_due < 0"
    for cap in (5, None):
        with pytest.raises(guarded.TimedOut):
            guarded.query(Catalog(spark, sf_dir, "tools"), slow, cap, seconds=1)
    assert guarded.query(Catalog(spark, sf_dir, "tools"), "SELECT count(*) AS n FROM party").rows.first()["n"] > 0


def test_documents(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    triples = documents.read_turtle(TURTLE)
    assert ("fin:Individual", "rdfs:label", "Individual Person") in triples and ("fin:Individual", "rdfs:isDefinedBy", "fibo:Person") in triples and ("fin:isNpl", "rdfs:range", "xsd:boolean") in triples
    assert documents.read_ddl(DDL) == {"financial.party": {"party_id": None, "party_type": ["INDIVIDUAL", "ORGANIZATION"]}}
    assert documents.write_dbml(c).count("Table ") == 19 and documents.write_dbml(c) == documents.write_dbml(c)
    line = documents.write_turtle(c.table("party_role_customer"), c.table("deposit_account")).where("value like 'fin:customer%'").first()[0]
    assert '"^^xsd:boolean .' in line
    found = documents.evaluate_contract(c, {"table": "party", "quality": [{"rule": "rowCountGreaterThan", "value": 1}, {"rule": "columnNoNulls", "column": "party_bk"}], "columns": [{"name": "party_type", "allowedValues": ["INDIVIDUAL"]}], "uniqueKey": "party_id"})
    assert {(r["assertion"], r["passed"]) for r in found.collect()} == {("row_count_between", True), ("not_null", True), ("unique", True), ("allowed_values", False)}
    assert documents.search_catalog(c, "loan collateral value").first()["table_name"] == "loan_collateral"
