"""Retrieval over all stores at once: an intent chooses a metric query, a relational query and a graph pattern."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import governance, telemetry, vector
from marlstone.operators.graph import Graph
from marlstone.operators.ontology import Ontology
from marlstone.plans import guarded
from marlstone.plans.guarded import masked
from marlstone.plans.model import CUBES, PRIVILEGED, Cube
from marlstone.plans.semantic import AccessDenied, SemanticLayer
from marlstone.sources.bindings import Catalog

# Metrics that an intent asks for.
METRICS = {
    "collateral": ("loan_collateral", ("total_collateral_assets", "total_appraised_value")),
    "deposit": ("deposit_account", ("total_deposit_accounts", "overdrawn_account_count")),
    "aml_risk": ("party_role_customer", ("high_aml_risk_count", "active_customers_count")),
    "default": ("party", ("total_party_masters",)),
}


def _decimal_sum(column: str):
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


def relational(catalog: Catalog, intent: str) -> DataFrame:
    """The overview rows of an intent: at most ten groups."""
    active = lambda t: catalog.table(t).where("md_is_active")
    if intent == "collateral":
        return active("loan_collateral").groupBy("collateral_type").agg(F.count(F.lit(1)).alias("asset_count"), _decimal_sum("estimated_value").alias("total_value")).orderBy(F.desc("total_value"), "collateral_type").limit(10)
    if intent == "deposit":
        joined = active("deposit_account").join(active("deposit_balance").select("deposit_account_id", "available_balance"), "deposit_account_id")
        return joined.groupBy("account_type").agg(F.count(F.lit(1)).alias("account_count"), _decimal_sum("available_balance").alias("total_available_balance")).orderBy(F.desc("total_available_balance"), "account_type").limit(10)
    if intent == "aml_risk":
        return active("party_role_customer").groupBy("aml_risk_rating", "kyc_status").agg(F.count(F.lit(1)).alias("customer_count")).orderBy(F.desc("customer_count"), "aml_risk_rating", "kyc_status").limit(10)
    return active("party").groupBy("party_type").agg(F.count(F.lit(1)).alias("party_count"))


def graph_pattern(graph: Graph, intent: str) -> DataFrame:
    if intent == "collateral":
        return graph.match("LoanAgreement", "SECURED_BY", "LoanCollateral", columns=["n0.loan_agreement_id AS loan_agreement_id", "n1.collateral_type AS collateral_type", "cast(n1.estimated_value AS double) AS estimated_value", "n1.l_partkey AS l_partkey", "n1.l_suppkey AS l_suppkey"], order=[F.desc("estimated_value"), "loan_agreement_id", "l_partkey", "l_suppkey"], limit=5)
    if intent == "deposit":
        return graph.match("Customer", "HOLDS_ACCOUNT", "DepositAccount", "HAS_BALANCE", "DepositBalance", columns=["n0.customer_number AS customer_number", "n1.account_type AS account_type", "cast(n2.available_balance AS double) AS available_balance"], order=["available_balance", "customer_number"], limit=5)
    if intent == "aml_risk":
        people = graph.nodes("Individual").select("node_id", "first_name", "last_name")
        roles = graph.nodes("Customer").where("aml_risk_rating = 'HIGH'").select(F.col("party_id").alias("node_id"), "customer_number", "aml_risk_rating")
        return people.join(roles, "node_id").select(F.concat("first_name", F.lit(" "), "last_name").alias("full_name"), "customer_number", "aml_risk_rating").orderBy("customer_number").limit(5)
    return graph.nodes("Party").groupBy("party_type").agg(F.count(F.lit(1)).alias("n_parties")).orderBy(F.desc("n_parties"), "party_type")


#: Columns that show what only the privileged role may see.
RESTRICTED = frozenset(m.split(".")[1] for m in PRIVILEGED)
PAYLOAD = "tier string, status string, payload string, n_redactions bigint, safety_status string"


def compile_pattern(graph: Graph, prompt: str) -> tuple[DataFrame, str]:
    """The graph pattern of a prompt's intent, at most ten rows and masked, and what it shows."""
    intent = graph.catalog.spark.range(1).select(text.intent(F.lit(prompt))).first()[0]
    shows = {"collateral": "Loans and the collateral that secures them", "deposit": "Customers, their accounts and lowest balances", "aml_risk": "Individuals who are customers of high risk", "default": "Parties by type"}
    return masked(graph_pattern(graph, intent)).limit(10), shows[intent]


def cube_documents(spark: SparkSession) -> DataFrame:
    """(fqn, content): a text for each cube, of its dimensions and measures."""
    return spark.createDataFrame([(c.name, cube_text(c)) for c in CUBES.values()], "fqn string, content string")


def cube_text(cube: Cube) -> str:
    return f"Cube {cube.name} with dimensions {', '.join(cube.dimensions)} and measures {', '.join(cube.measures)}".replace("_", " ")


def vector_tier(spark: SparkSession, prompts: DataFrame, fetch: int = 10, k: int = 3) -> DataFrame:
    """The cubes nearest to each prompt by hashed vectors, re-ranked by shared words."""
    return vector.prompt_search(cube_documents(spark), prompts, text.overlap_score(F.col("prompt"), F.col("content")), fetch, k, degraded=True)


def hybrid(catalog: Catalog, prompt: str, role: str | None = None, sql: str | None = None, pattern: Callable[[Graph], DataFrame] | None = None, trace: telemetry.Trace | None = None) -> DataFrame:
    """(tier, status, payload, n_redactions, safety_status): one row for each tier's result, as sanitised JSON.

    A prompt that carries an injection is refused in one row. Each tier is run by itself, so one
    that fails, while it is planned or while it runs, leaves the others whole; its payload is null,
    and what went wrong is in the trace, not where an answerer could take it for evidence. A caller
    without the privileged role gets no metrics of risk and no list of persons at risk, and
    restricted columns masked, as personal ones are for everybody, by what they are made from.

    sql (a guarded statement) and pattern (of a graph) take the place of the intent's own. trace
    gets each tier's time and error, the prompt without personal data, and which encoder and
    re-ranker answered: the hashed and lexical stand-ins are named as what they are.
    """
    spark = catalog.spark
    asked = spark.createDataFrame([(0, prompt)], "prompt_id int, prompt string")
    seen = asked.select(text.intent(F.col("prompt")).alias("intent"), F.size(text.injections(F.col("prompt"))).alias("bad"), text.redact(F.col("prompt")).alias("shown")).first()
    trace = trace or telemetry.Trace(prompt)
    trace.shown, trace.backend = seen["shown"], {"embedding": "degraded", "reranker": "degraded"}
    if seen["bad"]:
        return spark.createDataFrame([("guard", "BLOCKED", None, 0, "REVIEW_REQUIRED")], PAYLOAD)
    intent = seen["intent"]
    cube, measures = METRICS[intent]

    def graph() -> DataFrame:
        if pattern is not None:
            return pattern(Graph(catalog)).limit(10)
        if intent == "aml_risk" and role != "privileged":
            raise AccessDenied("a list of persons at risk is for the privileged role")
        return graph_pattern(Graph(catalog), intent)

    tiers: dict[str, Callable[[], DataFrame]] = {
        "vector": lambda: vector_tier(spark, asked),
        "graph": graph,
        "metrics": lambda: SemanticLayer(catalog).load({"measures": [f"{cube}.{m}" for m in measures]}, role),
        "relational": lambda: guarded.query(catalog, sql).rows if sql else relational(catalog, intent),
        "ontology": lambda: Ontology(spark).expand(asked),
    }
    rows = []
    for tier, run in tiers.items():
        began = time.perf_counter()
        error = None
        try:
            df = guarded.masked(run(), () if role == "privileged" else RESTRICTED)
            body = df.agg(F.to_json(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("payload"))  # tiers give a few rows
            found = body.select(governance.sanitised(F.col("payload")).alias("p")).first()["p"]
            rows.append((tier, "OK", found["payload"], found["pii_redactions_applied"], found["safety_status"]))
        except Exception as e:  # one store that fails must not take the others with it
            error = f"{type(e).__name__}: {e}"[:200]
            rows.append((tier, "FAILED", None, 0, "SECURE"))
        trace.record(tier, (time.perf_counter() - began) * 1000, error)
    return spark.createDataFrame(rows, PAYLOAD)


def respond(catalog: Catalog, prompt: str, answer: Callable[[str, list[str]], str], role: str | None = None, sql: str | None = None, pattern: Callable[[Graph], DataFrame] | None = None, spans: str | None = None) -> tuple[str, dict]:
    """An answer made by a pluggable answerer from the tiers' payloads, its scores, trace and backend; spans names the table that its spans go to."""
    trace = telemetry.Trace(prompt)
    context = [r["payload"] for r in hybrid(catalog, prompt, role, sql, pattern, trace).collect() if r["status"] == "OK"]
    given = answer(prompt, context)
    row = catalog.spark.createDataFrame([(prompt, " ".join(context), given)], "p string, c string, r string")
    scores = row.select(telemetry.judged(F.col("p"), F.col("c"), F.col("r")).alias("s")).first()["s"].asDict()
    final = trace.finalise(given)
    if spans:
        telemetry.write_spans(telemetry.span_rows(catalog.spark, [trace]), spans)
    return given, scores | {"trace": final, "errors": trace.errors, "backend": trace.backend}
