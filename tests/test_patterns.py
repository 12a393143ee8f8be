"""Patterns and hops over a graph small enough to walk by hand."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import patterns
from marlstone.operators.graph import EDGES, NODES, Graph
from marlstone.operators.patterns import Pattern, StoredGraph
from marlstone.plans.guarded import Rejected
from marlstone.sources.bindings import Catalog, Overlay


def test_back_equals_forth(spark, sf_dir):
    g = Graph(Catalog(spark, sf_dir))
    forth = Pattern(g, "c", "Customer").out("HOLDS_ACCOUNT", "a", "DepositAccount").out("HAS_BALANCE", "b", "DepositBalance")
    back = Pattern(g, "b", "DepositBalance").into("HAS_BALANCE", "a", "DepositAccount").into("HOLDS_ACCOUNT", "c", "Customer")
    columns = ["c.node_id AS c", "b.node_id AS b", "a.account_type AS t"]
    assert sorted(forth.rows(columns, cap=None).collect()) == sorted(back.rows(columns, cap=None).collect())
    assert back.rows(columns).count() == 10


def test_optional_step_keeps_what_has_none(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    g = Graph(Overlay(c, {"loan_agreement": c.table("loan_agreement").where("customer_id % 3 <> 0")}, "few"))
    found = Pattern(g, "c", "Customer").out("BORROWER_OF", "l", "LoanAgreement", optional=True).rows(["c.node_id AS c", "l.node_id AS l"], cap=None)
    assert found.where("l is null").count() == g.degrees("Customer", "BORROWER_OF").where("n = 0").count() > 0
    assert found.where("l is not null").count() == g.edge("BORROWER_OF", "Customer").count()


def test_masked_and_refused(spark, sf_dir):
    g = Graph(Catalog(spark, sf_dir))
    rows = Pattern(g, "i", "Individual").out("CITIZEN_OF", "r", "RefCountry").rows(["upper(i.last_name) AS x", "r.country_name AS country", "'i.last_name' AS said"]).collect()
    assert {r["x"] for r in rows} == {"[REDACTED]"} and {r["said"] for r in rows} == {"i.last_name"} and all(r["country"] for r in rows)
    for pattern in (Pattern(g, "i", "Individual").where("i.last_name = 'x'"), Pattern(g, "i", "Individual")):
        with pytest.raises(Rejected):
            pattern.rows(["i.node_id AS n", "i.last_name AS l"], ["l"])
    with pytest.raises(ValueError):
        Pattern(g, "i", "Individual").out("SECURED_BY", "c", "LoanCollateral")
    assert Pattern(Graph(Catalog(spark, sf_dir, "nobody")), "p", "Party").rows(["p.node_id AS n"]).count() == 0


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_reach_over_cycles(spark, sf_dir, monkeypatch, direction):
    """Random edges with cycles and loops, against a breadth-first walk."""
    rng = random.Random(direction)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(20)}
    stored = StoredGraph(Graph(Catalog(spark, sf_dir)))
    turned = {"out": edges, "in": {(b, a) for a, b in edges}, "both": edges | {(b, a) for a, b in edges}}[direction]
    frame = spark.createDataFrame([("N", str(a), "N", str(b)) for a, b in turned], "src_label string, src string, dst_label string, dst string")
    monkeypatch.setattr(stored, "edges", lambda kinds, way: frame)
    starts = spark.createDataFrame([("N", 0), ("N", 5), ("N", 5)], "label string, node_id int")
    got = {(r["start"], r["node_id"]): r["hops"] for r in stored.reach(starts, 3, 1, (), direction).collect()}
    expected = {}
    for s in (0, 5):
        seen, frontier = {s: 0}, {s}
        for hop in range(1, 4):
            frontier = {b for a, b in turned if a in frontier} - set(seen)
            seen |= dict.fromkeys(frontier, hop)
        expected |= {(str(s), str(n)): h for n, h in seen.items() if h}
    assert got == expected


def test_several_hops_in_a_pattern(spark, sf_dir):
    g = Graph(Catalog(spark, sf_dir))
    found = Pattern(g, "p", "Party").out("", "b", "DepositBalance", hops=(1, 3)).where("p.node_id % 10 = 0").rows(["p.node_id AS p", "b.node_id AS b", "b.hops AS hops"], cap=None)
    plain = Pattern(g, "p", "Party").out("PLAYS_ROLE", "c", "Customer").out("HOLDS_ACCOUNT", "a", "DepositAccount").out("HAS_BALANCE", "b", "DepositBalance").where("p.node_id % 10 = 0").rows(["p.node_id AS p", "b.node_id AS b"], cap=None)
    assert sorted(found.drop("hops").collect()) == sorted(plain.distinct().collect()) and {r["hops"] for r in found.collect()} == {3}
    with pytest.raises(ValueError):
        StoredGraph(g).reach(g.nodes("Party").select(F.lit("Party").alias("label"), "node_id"), 99)


def test_stored_by_kind_and_label(spark, sf_dir, monkeypatch, tmp_path):
    """Each kind and label is written by itself, what is missing once more, however many keys there are."""
    monkeypatch.setattr(patterns, "shared_dir", lambda spark: str(tmp_path))
    g = Graph(Catalog(spark, sf_dir))
    for rows in (10, 10**6):
        monkeypatch.setattr(patterns, "TASK_ROWS", rows, raising=False)
        stored = StoredGraph(g).build()
        assert {r["kind"] for r in stored.edges().sparkSession.read.parquet(f"{stored.folder}/edges").select("kind").distinct().collect()} == {e[0] for e in EDGES}
        assert all(stored.files.exists(f"{stored.folder}/edges/kind={e[0]}/_SUCCESS") for e in EDGES) and all(stored.files.exists(f"{stored.folder}/nodes/label={x}/_SUCCESS") for x in NODES)
        expected = {(e[1], e[3]): 0 for e in EDGES} | {(e[1], e[3]): g.edges(*e).count() for e in EDGES}
        assert {(r["src_label"], r["dst_label"]): r["count"] for r in stored.edges().groupBy("src_label", "dst_label").count().collect()} == {k: n for k, n in expected.items() if n}
        stored.files.delete(f"{stored.folder}/edges")


@pytest.mark.parametrize("direction", ["out", "both"])
def test_reach_deals_edges_by_their_number(spark, sf_dir, monkeypatch, direction):
    """With more edges than one task is meant for: as many tasks as they ask for, hubs dealt to several, the nodes of a breadth-first walk."""
    monkeypatch.setattr(patterns, "TASK_ROWS", 20, raising=False)
    rng = random.Random(7)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(100)} | {(3, n) for n in range(80)} | {(n, 5) for n in range(50)}
    both = [(a, b) for a, b in edges] + [(b, a) for a, b in edges]  # as edges() has them: pairs in both directions come twice
    turned = list(edges) if direction == "out" else both
    stored = StoredGraph(Graph(Catalog(spark, sf_dir)))
    frame = spark.createDataFrame([("N", str(a), "N", str(b)) for a, b in turned], "src_label string, src string, dst_label string, dst string")
    monkeypatch.setattr(stored, "edges", lambda kinds, way: frame)
    starts = [0, 3, 5, 17]
    found = stored.reach(spark.createDataFrame([("N", s) for s in starts], "label string, node_id int"), 3, 1, (), direction)
    assert found.rdd.getNumPartitions() >= len(turned) // 20
    expected = {}
    for s in starts:
        seen, frontier = {s: 0}, {s}
        for hop in range(1, 4):
            frontier = {b for a, b in turned if a in frontier} - set(seen)
            seen |= dict.fromkeys(frontier, hop)
        expected |= {(str(s), str(n)): h for n, h in seen.items() if h}
    rows = found.collect()
    assert len(rows) == len(expected) and {(r["start"], r["node_id"]): r["hops"] for r in rows} == expected
    degree = {n: sum(a == n for a, _ in turned) for n in range(80)}
    assert {int(r["hub"]): r["parts"] for r in patterns._hubs(frame, len(turned)).collect()} == {n: -(-d // 20) for n, d in degree.items() if d > 20}
