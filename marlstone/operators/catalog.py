"""The data catalog as DataFrames: entities, tags, constraints, search, and quality suites by table name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import governance, quality
from marlstone.plans.model import CUBES
from marlstone.sources.bindings import Catalog
from marlstone.sources.contracts import ALLOWED

#: Assertions by table: bounds of the row count, columns that must be filled, columns that must be unique.
SUITES: dict[str, tuple[tuple[int, int], tuple[str, ...], tuple[str, ...]]] = {
    "party": ((1, 10**12), ("party_id", "party_bk", "party_type"), ("party_id", "party_bk")), "party_individual": ((1, 10**12), ("party_id", "first_name", "gender"), ("party_individual_id",)),
    "party_organization": ((1, 10**12), ("party_id", "legal_name"), ("party_organization_id", "registration_number")), "party_role_customer": ((1, 10**12), ("party_id", "aml_risk_rating"), ("party_role_customer_id", "customer_number")),
    "deposit_account": ((1, 10**12), ("account_number", "currency_code"), ("deposit_account_id", "account_number")), "deposit_balance": ((1, 10**12), ("available_balance", "ledger_balance"), ("deposit_balance_id",)),
    "deposit_transaction": ((1, 10**12), ("amount", "transaction_type"), ("deposit_transaction_id",)), "loan_application": ((1, 10**12), ("requested_amount",), ("loan_application_id",)),
    "loan_agreement": ((1, 10**12), ("principal_amount", "interest_rate"), ("loan_agreement_id", "agreement_number")), "loan_repayment_schedule": ((1, 100), ("total_due", "paid_date"), ("loan_repayment_schedule_id",)),
    "loan_collateral": ((1, 10**12), ("estimated_value",), ()), "ref_country": ((1, 300), ("country_code",), ("country_code",)),
}


def kind(data_type):
    """The catalog's type of a column, by its name in the schema; what it doesn't know is text of 255 characters."""
    t = F.lower(data_type)
    rules = (("bigint", "BIGINT"), ("int", "INT"), ("decimal", "DECIMAL"), ("double", "DOUBLE"), ("float", "FLOAT"), ("boolean", "BOOLEAN"), ("timestamp", "TIMESTAMP"), ("date", "DATE"))
    found = F.when(F.lit(False), F.lit(""))
    for part, name in rules:
        found = found.when(t.startswith(part), name)
    return found.otherwise("VARCHAR(255)")


def columns(catalog: Catalog, comments: DataFrame | None = None) -> DataFrame:
    """(schema_name, table_name, column_name, data_type, position, comment); comments: (table_name, column_name, comment)."""
    own = catalog.columns().withColumn("schema_name", F.when(F.col("table_name").startswith("ref_"), "ref").otherwise("financial"))
    noted = own.withColumn("comment", F.lit(None).cast("string")) if comments is None else own.join(F.broadcast(comments), ["table_name", "column_name"], "left")
    return noted.select("schema_name", "table_name", "column_name", "data_type", "position", "comment")


def entities(catalog: Catalog, comments: DataFrame | None = None) -> DataFrame:
    """(fqn, name, description, tags, columns): one entity for each table, tagged by the personal data it has."""
    none = F.array().cast("array<string>")
    cols = governance.tagged(columns(catalog, comments).withColumn("tags", none))
    listed = F.array_sort(F.collect_list(F.struct("position", "column_name", kind(F.col("data_type")).alias("type"), "comment", "tags")))
    out = cols.groupBy("schema_name", "table_name").agg(listed.alias("columns"))
    tags = F.array_sort(F.array_distinct(F.flatten(F.transform("columns", lambda c: c["tags"]))))
    described = F.concat(F.lit("Table "), "table_name", F.lit(": "), F.array_join(F.transform("columns", lambda c: c["column_name"]), ", "))
    return out.select(F.concat_ws(".", "schema_name", "table_name").alias("fqn"), F.col("table_name").alias("name"), described.alias("description"), tags.alias("tags"), "columns")


def upsert(known: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by fqn: new ones replace those they name and are added else; of new rows with one fqn one counts."""
    fresh = new.dropDuplicates(["fqn"])
    return known.join(fresh.select("fqn"), "fqn", "left_anti").select(*known.columns).unionByName(fresh.select(*known.columns))


def get(known: DataFrame, fqn: str) -> DataFrame:
    return known.where(F.col("fqn") == fqn)


def search(known: DataFrame, question: str, k: int = 5) -> DataFrame:
    """(name, fqn, score, description, tags): the k entities whose name and description have most words of a question."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(c, "_", " ")), F.lit("[a-z0-9]+"), F.lit(0)))
    scored = known.withColumn("score", F.size(F.array_intersect(words(F.concat_ws(" ", "name", "description")), words(F.lit(question)))).cast("bigint"))
    return scored.where("score > 0").orderBy(F.desc("score"), "name").limit(k).select("name", "fqn", "score", F.substring("description", 1, 200).alias("description"), "tags")


def resolve(known: DataFrame, name: str) -> DataFrame:
    """The entity with exactly this name, upper and lower case alike."""
    return known.where(F.lower("name") == name.lower()).limit(1)


def constraints(catalog: Catalog) -> DataFrame:
    """(table_name, kind, columns, refers_to): primary keys, foreign keys and lists of allowed values."""
    rows = [(c.name, "PRIMARY KEY", c.key, None) for c in CUBES.values()]
    for c in CUBES.values():
        for j in c.joins:
            if j.relationship == "belongs_to":
                own, their = (x.strip() for x in j.on.split("="))
                rows.append((c.name, "FOREIGN KEY", own.removeprefix("$"), their.removeprefix("$")))
    rows += [(t, "CHECK", c, ",".join(v)) for t, checks in ALLOWED.items() for c, v in checks.items()]
    return catalog.spark.createDataFrame(rows, "table_name string, kind string, columns string, refers_to string")


def _suite(catalog: Catalog, table: str) -> quality.Suite:
    bounds, filled, unique = SUITES[table]
    df = catalog.table(table)
    return quality.Suite(table, df.where("md_is_active") if "md_is_active" in df.columns else df, bounds, filled, unique, ALLOWED.get(table))


def suite(catalog: Catalog, table: str) -> DataFrame:
    """(table_name, assertion, column_name, n_failing, passed) of a table's suite, over active rows where the table has the flag."""
    return quality.suites([_suite(catalog, table)])


def all_suites(catalog: Catalog) -> DataFrame:
    return quality.suites([_suite(catalog, t) for t in SUITES])


def check_data_quality(catalog: Catalog, name: str) -> DataFrame | str:
    """(test_name, status, result_message) of the table with exactly this name, or a message that there is none or it has no suite."""
    found = next((t for t in catalog.names() if t.lower() == name.lower()), None)
    if found is None:
        return f"No table named '{name}' found in the catalog."
    if found not in SUITES:
        return f"No active data quality assertions for {name}."
    test = F.concat_ws("_", "table_name", "assertion", F.when(F.col("column_name") != "", F.col("column_name")))
    status = F.when(F.col("passed"), "Success").otherwise("Failed")
    return suite(catalog, found).select(test.alias("test_name"), status.alias("status"), F.concat(F.col("n_failing").cast("string"), F.lit(" failing")).alias("result_message"))


def profiles(catalog: Catalog, tables: list[str], first: int = 5) -> DataFrame:
    """quality.profiles of the first columns of each table; a table that the catalog doesn't have has no rows."""
    known = [(t, catalog.table(t)) for t in tables if t in catalog.names()]
    if not known:
        return catalog.spark.createDataFrame([], "table_name string, column_name string, n_rows bigint, n_values bigint, n_nulls bigint, n_distinct bigint")
    return quality.profiles([(t, df, df.columns[:first]) for t, df in known])
