"""Five scenarios that ask the stores together, each a list of checks; a suite's score is the share that hold."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import catalog as catalogs
from marlstone.operators.graph import Graph
from marlstone.operators.patterns import Pattern
from marlstone.plans import guarded, retrieve
from marlstone.plans.semantic import SemanticLayer
from marlstone.sources.bindings import Catalog

RESULTS = "scenario string, n_checks bigint, n_passed bigint, score double, ms double"


def _tiers(catalog: Catalog, prompt: str) -> dict:
    return {r["tier"]: r for r in retrieve.hybrid(catalog, prompt, "privileged").collect()}


def exposure(catalog: Catalog) -> list[bool]:
    """Retrieval about customers at risk: every tier answers, and no name is shown."""
    tiers = _tiers(catalog, "individual customers of high aml risk and their parties")
    return [*(r["status"] == "OK" for r in tiers.values()), len(tiers) == 5, "[REDACTED]" in (tiers["graph"]["payload"] or "") or tiers["graph"]["payload"] == "[]"]


def liquidity(catalog: Catalog) -> list[bool]:
    """The metric layer's balance is that of a statement over the tables."""
    metric = SemanticLayer(catalog).load({"measures": ["deposit_balance.total_available_balance"]}, "privileged").first()[0]
    plain = guarded.query(catalog, "SELECT sum(cast(available_balance AS decimal(18,4))) AS total FROM deposit_balance").rows.first()["total"]
    return [metric is not None and abs(metric - float(plain)) < 1e-6 * max(1.0, abs(metric))]


def credit(catalog: Catalog) -> list[bool]:
    """Loans and what secures them, from the graph and from the metrics."""
    found = Pattern(Graph(catalog), "l", "LoanAgreement").out("SECURED_BY", "k", "LoanCollateral").rows(["l.node_id AS loan", "cast(k.estimated_value AS double) AS value"], ["value", "loan"]).collect()
    ratio = SemanticLayer(catalog).load({"measures": ["loan_agreement.npl_default_ratio"]}, "privileged").first()[0]
    return [len(found) == 10, found == sorted(found, key=lambda r: (r["value"], r["loan"])), ratio is not None and 0 <= ratio <= 100]


def quality(catalog: Catalog) -> list[bool]:
    """The suites of three tables have results, and their keys are unique."""
    found = [r for t in ("party", "deposit_account", "loan_agreement") for r in catalogs.suite(catalog, t).collect()]
    return [len(found) > 0, all(r["passed"] for r in found if r["assertion"] == "unique")]


def tools(catalog: Catalog) -> list[bool]:
    """From a question to its table, to rows of it without personal data; a writing statement is refused."""
    table = catalogs.search(catalogs.entities(catalog), "individual first last name", 1).first()["name"]
    rows = guarded.query(catalog, f"SELECT * FROM {table}").rows.collect()
    shown = {r["last_name"] for r in rows} if rows and "last_name" in rows[0].asDict() else {"[REDACTED]"}
    try:
        guarded.query(catalog, f"DELETE FROM {table}")
        refused = False
    except guarded.Rejected:
        refused = True
    return [0 < len(rows) <= guarded.ROW_CAP, shown <= {"[REDACTED]", None}, refused]


SCENARIOS: dict[str, Callable[[Catalog], list[bool]]] = {"exposure": exposure, "liquidity": liquidity, "credit": credit, "quality": quality, "tools": tools}


def run(catalog: Catalog) -> DataFrame:
    """(scenario, n_checks, n_passed, score, ms) of each scenario; one that raises has no checks and a score of 0."""
    rows = []
    for name, scenario in SCENARIOS.items():
        began = time.perf_counter()
        try:
            checks = scenario(catalog)
        except Exception:  # a scenario that breaks is a result, too
            checks = []
        rows.append((name, len(checks), sum(checks), 100.0 * sum(checks) / len(checks) if checks else 0.0, (time.perf_counter() - began) * 1000))
    return catalog.spark.createDataFrame(rows, RESULTS)


def passed(results: DataFrame) -> DataFrame:
    return results.select("scenario", "n_checks", "n_passed", F.round("score", 2).alias("score"))
