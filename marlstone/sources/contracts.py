"""Data contracts and cube files: YAML readers, rules, drift of columns and values, freshness, and their texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import quality
from marlstone.sources.bindings import Catalog

#: The contracts of the logical tables, as their files would say them.
CONTRACTS = """
name: Party Data Product Contract
version: "1.0"
status: active
domain: Party
owner: {name: Party Team}
sla: {freshness: 15 minutes, availability: 99.9%, retention: 7 years, data_quality_score: ">= 99%"}
models:
  financial.party:
    description: Parties of every kind
    columns:
      party_id: {nullable: false, primary_key: true}
      party_bk: {nullable: false, pii_classification: PersonalData.SpecialCategory}
      party_type: {nullable: false, allowed_values: [INDIVIDUAL, ORGANIZATION]}
      status_code: {nullable: false, allowed_values: [ACTIVE, INACTIVE, SUSPENDED]}
quality:
  - {type: rowCountGreaterThan, value: 10}
  - {type: columnNoNulls, column: party_id}
---
name: Deposit Data Product Contract
version: "1.1"
status: active
domain: Deposits
owner: {name: Deposit Team}
sla: {freshness: 5 minutes, availability: 99.95%, retention: 10 years, data_quality_score: ">= 99.5%"}
models:
  financial.deposit_account:
    description: Accounts
    columns:
      deposit_account_id: {nullable: false, primary_key: true}
      account_number: {nullable: false, pii_classification: PersonalData.Personal}
      account_type: {nullable: false, allowed_values: [SAVINGS, CHECKING]}
      account_status: {nullable: false, allowed_values: [ACTIVE, DORMANT, FROZEN, CLOSED]}
      overdraft_code: {nullable: true}
quality:
  - {type: rowCountGreaterThan, value: 1000000000}
  - {type: columnNoNulls, column: account_number}
---
name: Loan Data Product Contract
version: "0.9"
status: draft
domain: Loans
owner: {name: Loan Team}
sla: {freshness: 1 hour, availability: 99.9%, retention: 10 years, data_quality_score: ">= 98%"}
models:
  financial.loan_agreement:
    description: Contracts
    columns:
      loan_agreement_id: {nullable: false, primary_key: true}
      agreement_status: {nullable: false, allowed_values: [ACTIVE, DEFAULTED, PAID_OFF, FROZEN]}
  loan_guarantee:
    description: A model without its schema
  financial.loan_guarantor:
    description: A table that isn't there
    columns: {}
quality:
  - {type: columnNoNulls, column: loan_agreement_id}
"""
# Values that the stores let into a column.
ALLOWED: dict[str, dict[str, tuple[str, ...]]] = {
    "party": {"party_type": ("INDIVIDUAL", "ORGANIZATION"), "status_code": ("ACTIVE", "INACTIVE", "SUSPENDED")},
    "party_role_customer": {"customer_segment": ("RETAIL", "SME", "CORPORATE", "WEALTH"), "kyc_status": ("VERIFIED", "PENDING", "EXPIRED"), "aml_risk_rating": ("LOW", "MEDIUM", "HIGH")},
    "party_address": {"address_type": ("RESIDENTIAL", "REGISTERED", "MAILING")},
    "party_identification": {"id_type": ("PASSPORT", "NATIONAL_ID", "TAX_ID", "LEI"), "verification_status": ("VERIFIED", "UNVERIFIED")},
    "deposit_account": {"account_type": ("SAVINGS", "CHECKING", "TERM_DEPOSIT"), "account_status": ("ACTIVE", "DORMANT", "FROZEN", "CLOSED")},
    "deposit_transaction": {"transaction_type": ("DEPOSIT", "WITHDRAWAL", "TRANSFER_IN", "TRANSFER_OUT", "INTEREST_CREDIT", "FEE"), "transaction_status": ("BOOKED", "PENDING", "REVERSED")},
    "deposit_interest_term": {"rate_type": ("FIXED", "VARIABLE"), "accrual_frequency": ("DAILY", "MONTHLY", "ANNUALLY"), "calculation_basis": ("ACT/360", "ACT/365", "30/360")},
    "deposit_overdraft_facility": {"facility_status": ("ACTIVE", "SUSPENDED", "CANCELLED")},
    "loan_application": {"application_status": ("SUBMITTED", "UNDERWRITING", "APPROVED", "REJECTED")},
    "loan_agreement": {"agreement_status": ("ACTIVE", "DEFAULTED", "PAID_OFF")},
    "loan_repayment_schedule": {"installment_status": ("PENDING", "PAID", "OVERDUE", "PARTIALLY_PAID")},
    "loan_disbursement": {"disbursement_status": ("COMPLETED", "PENDING", "FAILED")},
    "loan_collateral": {"collateral_type": ("REAL_ESTATE", "VEHICLE", "SECURITIES", "CASH_DEPOSIT"), "collateral_status": ("PLEDGED", "RELEASED", "LIQUIDATED")},
}


def _yaml():
    try:
        import yaml
    except ImportError as e:  # an optional library
        raise RuntimeError("reading YAML needs the yaml library") from e
    return yaml


def read_contracts(*sources: tuple[str, str]) -> list[dict]:
    """Contracts of (name of the source, text), in order, each with its source; one text may hold several."""
    return [{**c, "source": name} for name, body in sources for c in _yaml().safe_load_all(body) if c]


def read_cube(body: str) -> dict | None:
    """The first cube of a cube file, or None."""
    cubes = (_yaml().safe_load(body) or {}).get("cubes") or []
    return cubes[0] if cubes else None


def contracts() -> list[dict]:
    return read_contracts(("contracts", CONTRACTS))


def markdown(contract: dict) -> str:
    """A contract as a page: its terms, and a line for each model with its personal columns."""
    get = lambda d, k: (d or {}).get(k, "?")
    sla = contract.get("sla")
    out = [f"# {get(contract, 'name')}", f"Version {get(contract, 'version')}, {str(get(contract, 'status')).upper()}, domain {get(contract, 'domain')}, owner {get(contract.get('owner'), 'name')}", ""]
    out += [f"- {title}: {get(sla, k)}" for title, k in (("Freshness", "freshness"), ("Availability", "availability"), ("Retention", "retention"), ("Quality", "data_quality_score"))]
    for name, model in (contract.get("models") or {}).items():
        personal = [c for c, spec in (model.get("columns") or {}).items() if isinstance(spec, dict) and spec.get("pii_classification")]
        out.append(f"- `{name}`: {model.get('description', '')}" + (f" (PII: {', '.join(personal)})" if personal else ""))
    return "\n".join(out) + "\n"


def sla_summary(all_contracts: list[dict]) -> str:
    line = lambda c: "- {}: Freshness {freshness}, Availability {availability}, Quality Threshold {data_quality_score}.".format(c["name"].removesuffix(" Contract"), **{"freshness": "?", "availability": "?", "data_quality_score": "?"} | c.get("sla", {}))
    return "\n".join(["Data Product SLAs:", *map(line, all_contracts)]) + "\n"


def products(spark: SparkSession, all_contracts: list[dict]) -> DataFrame:
    """(product, domain, version, status, n_models, description): a row for each contract, as a catalog registers it."""
    rows = [(c["name"].removesuffix(" Contract"), c.get("domain"), str(c.get("version")), c.get("status"), len(c.get("models") or {}), markdown(c)) for c in all_contracts]
    return spark.createDataFrame(rows, "product string, domain string, version string, status string, n_models int, description string")


def declared(spark: SparkSession, all_contracts: list[dict]) -> DataFrame:
    """(contract, model, column_name, allowed): a row for each declared column, or one with a null column for a model without any."""
    rows = []
    for c in all_contracts:
        for model, spec in (c.get("models") or {}).items():
            columns = (spec or {}).get("columns") or {None: {}}
            rows += [(c["name"], model, column, (d or {}).get("allowed_values")) for column, d in columns.items()]
    return spark.createDataFrame(rows, "contract string, model string, column_name string, allowed array<string>")


def schema(catalog: Catalog) -> DataFrame:
    """(model, column_name, permitted) of the logical tables; permitted is null where any value may be written."""
    rows = [(f"{'ref' if r['table_name'].startswith('ref_') else 'financial'}.{r['table_name']}", r["column_name"], list(ALLOWED.get(r["table_name"], {}).get(r["column_name"], ())) or None) for r in catalog.column_rows()]
    return catalog.spark.createDataFrame(rows, "model string, column_name string, permitted array<string>")


def find_drift(declared_rows: DataFrame, actual: DataFrame) -> DataFrame:
    """(contract, model, column_name, problem, detail): where contracts and schema disagree.

    unqualified_model (no schema in its name), missing_table, phantom_column, unwritable_value (a
    declared value that can't be written) and missing_value (a permitted one that isn't declared);
    detail lists values in order.
    """
    none = F.lit(None).cast("string")
    models = declared_rows.select("contract", "model").distinct()
    row = lambda df, column, problem, detail: df.select("contract", "model", column.alias("column_name"), F.lit(problem).alias("problem"), detail.alias("detail"))
    qualified = F.col("model").contains(".")
    tables = actual.select("model").distinct()
    there = declared_rows.where(F.col("column_name").isNotNull()).join(tables, "model", "left_semi")
    both = there.join(actual, ["model", "column_name"]).where(F.col("allowed").isNotNull() & F.col("permitted").isNotNull())
    listed = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    unwritable = both.withColumn("d", listed("allowed", "permitted")).where("d <> ''")
    missing = both.withColumn("d", listed("permitted", "allowed")).where("d <> ''")
    return reduce(
        DataFrame.unionByName,
        [
            row(models.where(~qualified), none, "unqualified_model", none),
            row(models.where(qualified).join(tables, "model", "left_anti"), none, "missing_table", none),
            row(there.join(actual, ["model", "column_name"], "left_anti"), F.col("column_name"), "phantom_column", none),
            row(unwritable, F.col("column_name"), "unwritable_value", F.col("d")),
            row(missing, F.col("column_name"), "missing_value", F.col("d")),
        ],
    )


def evaluate(catalog: Catalog, contract: dict) -> DataFrame:
    """The contract's rules over each of its models that is there: nulls, unique keys, allowed values, row counts; one shuffle for all."""
    parts = []
    rules = contract.get("quality") or ()
    for model, spec in (contract.get("models") or {}).items():
        table = model.partition(".")[2]
        if table not in catalog.names():
            continue
        df = catalog.table(table)
        columns = {c: d or {} for c, d in (spec.get("columns") or {}).items() if c in df.columns}
        filled = dict.fromkeys([c for c, d in columns.items() if d.get("nullable") is False] + [r["column"] for r in rules if r["type"] == "columnNoNulls" and r["column"] in df.columns])
        least = [r["value"] for r in rules if r["type"] == "rowCountGreaterThan"]
        parts.append(quality.Suite(table, df, (max(least) + 1, 1 << 62) if least else None, tuple(filled), tuple(c for c, d in columns.items() if d.get("primary_key")), {c: tuple(d["allowed_values"]) for c, d in columns.items() if d.get("allowed_values")}))
    if not parts:
        return catalog.spark.createDataFrame([], "table_name string, assertion string, column_name string, n_failing bigint, passed boolean")
    return quality.suites(parts)


def freshness(df: DataFrame, name: str, time: str, now: str, limit_seconds: int) -> DataFrame:
    """(table_name, age_seconds, fresh): the age of the newest row at an instant; a table without rows isn't fresh."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(F.col(time)).cast("timestamp"))
    return df.agg(age.alias("age_seconds")).select(F.lit(name).alias("table_name"), "age_seconds", F.coalesce(F.col("age_seconds") <= limit_seconds, F.lit(False)).alias("fresh"))
