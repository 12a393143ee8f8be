"""A small ontology: classes, subclass edges, lineage to tables, and expansion of questions to tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators.graph import closure
from marlstone.plans.model import CUBES
from marlstone.sources.bindings import Catalog

# Local name, label, comment, parent, groundings.
CLASSES: tuple[tuple[str, str, str, str | None, tuple[str, ...]], ...] = (
    ("Party", "Party Supertype", "Master autonomous entity capable of entering into legal contracts.", None, ("fibo-party:Party",)),
    ("Individual", "Individual Person", "Natural person entity with legal personality.", "Party", ("fibo-people:Person",)),
    ("Organization", "Organization Legal Entity", "Corporate legal entity or partnership.", "Party", ("fibo-org:LegalEntity",)),
    ("PartyRole", "Party Role", "Role played by a Party in a specific context.", None, ("fibo-party:PartyRole",)),
    ("Customer", "Customer Role", "Party playing the role of a banking customer.", "PartyRole", ("bian:CustomerRole", "fibo-partyrole:Customer")),
    ("DepositAccount", "Deposit Account", "Checking, Savings, or Term Deposit contract.", None, ("fibo-account:DepositAccount",)),
    ("DepositBalance", "Deposit Balance Snapshot", "Real-time ledger, available, and book balance state.", None, ()),
    ("LoanApplication", "Loan Application", "Credit application request during origination.", None, ("fibo-loanapp:LoanApplication",)),
    ("LoanAgreement", "Loan Agreement Contract", "Legally binding credit facility agreement.", None, ("fibo-loan:Loan",)),
    ("LoanCollateral", "Pledged Collateral Asset", "Asset pledged to secure a loan facility.", None, ()),
)
# Object properties by name, domain and range; datatype properties by name, domain and type.
OBJECT_PROPERTIES = (("playsRole", "Party", "PartyRole"), ("holdsAccount", "Customer", "DepositAccount"), ("hasBalanceSnapshot", "DepositAccount", "DepositBalance"), ("borrowerOf", "Customer", "LoanAgreement"), ("securedBy", "LoanAgreement", "LoanCollateral"))
DATATYPE_PROPERTIES = (("customerNumber", "Customer", "string"), ("amlRiskRating", "Customer", "string"), ("availableBalance", "DepositBalance", "decimal"), ("principalAmount", "LoanAgreement", "decimal"), ("isNpl", "LoanAgreement", "boolean"))
# Table and the entity type that its cube describes.
ENTITIES: dict[str, str] = {
    "party": "Party", "party_individual": "Individual", "party_organization": "Organization", "party_role_customer": "Customer", "party_address": "Address", "party_identification": "Identification",
    "deposit_account": "DepositAccount", "deposit_balance": "DepositBalance", "deposit_transaction": "DepositTransaction", "deposit_interest_term": "DepositInterestTerm", "deposit_overdraft_facility": "DepositOverdraftFacility",
    "loan_application": "LoanApplication", "loan_agreement": "LoanAgreement", "loan_repayment_schedule": "LoanRepaymentSchedule", "loan_disbursement": "LoanDisbursement", "loan_collateral": "LoanCollateral",
    "ref_country": "RefCountry", "ref_currency": "RefCurrency", "ref_nace_industry": "RefIndustry",
}
#: Tables by an external concept that grounds what they hold: names of our own choice, not a published mapping.
GROUNDINGS: dict[str, str] = {
    "party": "fibo-party:Party", "party_individual": "fibo-people:Person", "party_organization": "fibo-org:LegalEntity", "party_role_customer": "fibo-partyrole:Customer", "party_address": "fibo-place:Address", "party_identification": "fibo-people:IdentityDocument",
    "deposit_account": "fibo-account:DepositAccount", "deposit_balance": "fibo-account:Balance", "deposit_transaction": "fibo-pay:Transaction", "deposit_interest_term": "fibo-account:InterestTerm", "deposit_overdraft_facility": "fibo-loan:OverdraftFacility",
    "loan_application": "fibo-loanapp:LoanApplication", "loan_agreement": "fibo-loan:Loan", "loan_repayment_schedule": "fibo-loan:PaymentSchedule", "loan_disbursement": "fibo-loan:Disbursement", "loan_collateral": "fibo-loan:Collateral",
    "ref_country": "fibo-place:Country", "ref_currency": "fibo-currency:Currency", "ref_nace_industry": "fibo-org:IndustrySector",
}
#: Tables in one expansion at most.
MAX_TABLES = 12


def schema_of(table: str) -> str:
    return "ref" if table.startswith("ref_") else "financial"


def lineage(spark: SparkSession) -> DataFrame:
    """(table_name, cube, entity): table, the cube on it, what the cube describes."""
    rows = [(f"{schema_of(t)}.{t}", t, e) for t, e in ENTITIES.items()]
    return spark.createDataFrame(rows, "table_name string, cube string, entity string")


def column_lineage(spark: SparkSession) -> DataFrame:
    """(cube, member, source_column): members that are a bare column of the cube's table."""
    rows = []
    for c in CUBES.values():
        rows += [(c.name, d, f"{schema_of(c.name)}.{c.name}.{d}") for d in c.dimensions]
        rows += [(c.name, n, f"{schema_of(c.name)}.{c.name}.{m.sql[1:]}") for n, m in c.measures.items() if re.fullmatch(r"\$[A-Za-z_][A-Za-z0-9_]*", m.sql)]
    return spark.createDataFrame(rows, "cube string, member string, source_column string")


def grounded_entities(entities: DataFrame) -> DataFrame:
    """Catalog entities with the tag of the concept that grounds them; tagging twice changes nothing."""
    spark = entities.sparkSession
    known = F.broadcast(spark.createDataFrame([(t, f"Grounding.{g}") for t, g in GROUNDINGS.items()], "name string, grounding string"))
    own = F.when(F.col("grounding").isNotNull(), F.array_union("tags", F.array("grounding"))).otherwise(F.col("tags"))
    return entities.join(known, "name", "left").withColumn("tags", own).drop("grounding").select(*entities.columns)


class Ontology:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.classes = spark.createDataFrame([(n, label, comment) for n, label, comment, _, _ in CLASSES], "concept string, label string, definition string")
        self.subclass_of = spark.createDataFrame([(n, p) for n, _, _, p, _ in CLASSES if p], "child string, parent string")
        self.grounded = spark.createDataFrame([(n, g) for n, _, _, _, gs in CLASSES for g in gs], "concept string, external string")
        self.properties = spark.createDataFrame([(n, d, r, "object") for n, d, r in OBJECT_PROPERTIES] + [(n, d, r, "datatype") for n, d, r in DATATYPE_PROPERTIES], "property string, domain string, range string, kind string")

    def closure(self) -> DataFrame:
        return closure(self.spark, self.subclass_of)

    def describe(self) -> DataFrame:
        """Each concept with its subclasses, groundings, table and cube; branches are aggregated before they meet."""
        below = self.closure().groupBy(F.col("ancestor").alias("concept")).agg(F.array_sort(F.collect_set("descendant")).alias("subclasses"))
        external = self.grounded.groupBy("concept").agg(F.array_sort(F.collect_set("external")).alias("grounded_in"))
        bridge = lineage(self.spark).select(F.col("entity").alias("concept"), F.col("table_name").alias("source_table"), F.col("cube").alias("semantic_cube"))
        none = F.array().cast("array<string>")
        out = self.classes.join(below, "concept", "left").join(external, "concept", "left").join(bridge, "concept", "left")
        return out.withColumns({"subclasses": F.coalesce("subclasses", none), "grounded_in": F.coalesce("grounded_in", none)})

    def search(self, term: str) -> DataFrame:
        t = term.lower()
        found = F.lower("concept").contains(t) | F.lower("label").contains(t) | F.lower("definition").contains(t)
        return self.classes.where(found).orderBy("concept").limit(50)

    def query(self, operation: str, term: str = "") -> DataFrame:
        """list, describe, search or expand; an empty term is an error for all but list."""
        op = operation.strip().lower()
        if op != "list" and not term.strip():
            raise ValueError(f"{op} needs a term")
        if op == "list":
            return self.classes.orderBy("concept").limit(50)
        if op == "describe":
            t = term.lower()
            return self.describe().where((F.lower("concept") == t) | (F.lower("label") == t))
        if op == "search":
            return self.search(term)
        if op == "expand":
            return self.expand(self.spark.createDataFrame([(0, term)], "prompt_id int, prompt string"))
        raise ValueError(f"unknown operation {operation}")

    def ask(self, operation: str, term: str = "") -> DataFrame | str:
        """query(), or a sentence that says what was not found."""
        found = self.query(operation, term).limit(50)
        if not found.isEmpty():
            return found
        near = [r["concept"] for r in self.search(term[:4]).collect()] if term else []
        return f"No concept matches '{term.strip()}'." + (f" Close to it: {', '.join(near)}." if near else " Use list to see all.")

    def match(self, prompts: DataFrame) -> DataFrame:
        """(prompt_id, concept, match_reason): concepts all of whose name words, or else label words, a prompt has."""
        stop = F.array(*[F.lit(w) for w in text.LABEL_STOP_WORDS])
        concepts = self.classes.select("concept", text.tokens(text.split_camel(F.col("concept"))).alias("name"), F.array_except(text.tokens(F.col("label")), stop).alias("label_words"))
        asked = prompts.select("prompt_id", text.tokens(F.col("prompt")).alias("words"))
        both = asked.crossJoin(F.broadcast(concepts))  # the concepts are a fixed handful
        inside = lambda c: (F.size(c) > 0) & (F.size(F.array_except(F.col(c), F.col("words"))) == 0)
        return both.withColumn("match_reason", F.when(inside("name"), "name").when(inside("label_words"), "label")).where(F.col("match_reason").isNotNull()).select("prompt_id", "concept", "match_reason")

    def expand(self, prompts: DataFrame) -> DataFrame:
        """(prompt_id, concept, reason, source_table): matches and all their subclasses; a match's own reason wins."""
        hits = self.match(prompts).select("prompt_id", "concept", F.col("match_reason").alias("reason"), F.lit(0).alias("depth"))
        below = self.closure().select(F.col("ancestor").alias("concept"), "descendant", "depth")
        pulled = hits.select("prompt_id", "concept").join(below, "concept").select("prompt_id", F.col("descendant").alias("concept"), F.concat(F.lit("subclass of "), F.col("concept")).alias("reason"), "depth")
        first = hits.unionByName(pulled).groupBy("prompt_id", "concept").agg(F.min(F.struct("depth", "reason"))["reason"].alias("reason"))
        bridge = F.broadcast(lineage(self.spark).select(F.col("entity").alias("concept"), F.col("table_name").alias("source_table")))
        return first.join(bridge, "concept", "left").select("prompt_id", "concept", "reason", "source_table")

    def grounded_counts(self, catalog: Catalog, concepts: DataFrame) -> DataFrame:
        """(source_table, row_count) of the allow-listed tables behind concepts, active rows where the table has the flag."""
        allowed = {f"financial.{r['table_name']}": r["has_active_flag"] for r in catalog.allowed_tables().collect()}
        well = F.col("source_table").rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\z")  # anything else isn't a table's name
        named = [r["source_table"] for r in concepts.where(well).select("source_table").distinct().orderBy("source_table").limit(MAX_TABLES).collect()]
        probes = []
        for t in named:
            if t in allowed:
                df = catalog.table(t.split(".")[1])
                df = df.where("md_is_active") if allowed[t] else df
                probes.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("source_table"), "row_count"))
        empty = self.spark.createDataFrame([], "source_table string, row_count bigint")
        return reduce(DataFrame.unionByName, probes, empty)
