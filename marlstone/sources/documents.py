"""Readers and writers of the text formats around the tables: Turtle, DDL, DBML, contracts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import catalog as entity_catalog
from marlstone.operators import quality
from marlstone.plans.model import CUBES
from marlstone.sources.bindings import LOGICAL, Catalog

_STATEMENT = re.compile(r'"(?:[^"\\]|\\.)*"(?:@\w+)?|<[^>]*>|[^\s;,.<>"]+(?::[^\s;,]*[^\s;,.])?|[;,.]')


def read_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of the subset used here: prefixes, ';' and ',' lists, plain and tagged literals, 'a'."""
    triples: list[tuple[str, str, str]] = []
    body = "\n".join(line.split(" #")[0] if '"' not in line else line for line in text.splitlines() if not line.lstrip().startswith("#"))
    subject = predicate = None
    skip = False
    for token in _STATEMENT.findall(body):
        if token == "@prefix":
            skip = True
        elif token == ".":
            subject = predicate = None
            skip = False
        elif skip:
            continue
        elif token == ";":
            predicate = None
        elif token == ",":
            continue
        elif subject is None:
            subject = token
        elif predicate is None:
            predicate = "rdf:type" if token == "a" else token
        else:
            triples.append((subject, predicate, re.sub(r'^"(.*)"(?:@\w+)?$', r"\1", token, flags=re.S)))
    return triples


def turtle_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(read_turtle(text), "subject string, predicate string, object string")


def ontology_parts(triples: list[tuple[str, str, str]]) -> dict[str, list[tuple]]:
    """Triples as classes (name, label, comment), subclass edges, object properties (name, domain, range) and datatype properties."""
    by: dict[str, dict[str, list[str]]] = {}
    for subject, predicate, value in triples:
        by.setdefault(subject, {}).setdefault(predicate.split(":")[-1], []).append(value)
    first = lambda d, k: d.get(k, [None])[0]
    kind = lambda d, name: any(t.split(":")[-1] == name for t in d.get("type", ()))
    prop = lambda name: [(s, first(d, "domain"), first(d, "range")) for s, d in by.items() if kind(d, name)]
    return {
        "classes": [(s, first(d, "label"), first(d, "comment")) for s, d in by.items() if kind(d, "Class")],
        "subclass_of": [(s, parent) for s, d in by.items() for parent in d.get("subClassOf", ())],
        "object_properties": prop("ObjectProperty"),
        "datatype_properties": prop("DatatypeProperty"),
    }


def _literal(c: str) -> Column:
    """A column as a quoted Turtle literal, with the characters escaped that would end it."""
    text = F.col(c).cast("string")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def write_turtle(customers: DataFrame, accounts: DataFrame, loans: DataFrame | None = None) -> DataFrame:
    """One line of Turtle for each customer, account and loan, as a text column; literals are quoted, escaped and typed."""
    iri = lambda kind, c: F.concat(F.lit(f"fin:{kind}_"), F.col(c).cast("string"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value")
    lines = [
        customers.select(said(iri("customer", "party_role_customer_id"), " a fin:Customer ; fin:customerNumber ", _literal("customer_number"), " ; fin:isActive ", _literal("md_is_active"), "^^xsd:boolean .")),
        accounts.select(said(iri("account", "deposit_account_id"), " a fin:DepositAccount . ", iri("customer", "customer_id"), " fin:holdsAccount ", iri("account", "deposit_account_id"), " .")),
    ]
    if loans is not None:
        lines.append(loans.select(said(iri("loan", "loan_agreement_id"), " a fin:LoanAgreement ; fin:principalAmount ", _literal("principal_amount"), "^^xsd:decimal ; fin:isNpl ", _literal("is_npl"), "^^xsd:boolean . ", iri("customer", "customer_id"), " fin:borrowerOf ", iri("loan", "loan_agreement_id"), " .")))
    return reduce(DataFrame.unionByName, lines)


def read_graph_statements(text: str) -> list[str]:
    """Statements of a graph schema file: comment lines go first, as they may hold semicolons."""
    body = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("//"))
    return [s.strip() for s in body.split(";") if s.strip()]


def read_ddl(text: str) -> dict[str, dict[str, list[str] | None]]:
    """Tables of CREATE TABLE statements: column to its allowed values, if a CHECK lists them."""
    out: dict[str, dict[str, list[str] | None]] = {}
    for table, body in re.findall(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)\s*\((.*?)\n\s*\);", text, flags=re.I | re.S):
        columns: dict[str, list[str] | None] = {}
        for line in body.split("\n"):
            m = re.match(r"\s*(\w+)\s+\w", line)
            if m and m[1].upper() not in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "EXCLUDE"):
                allowed = re.search(r"\bIN\s*\(([^)]*)\)", line, flags=re.I)
                columns[m[1]] = re.findall(r"'([^']*)'", allowed[1]) if allowed else None
        out[table] = columns
    return out


def write_dbml(catalog: Catalog) -> str:
    """The logical tables as DBML with keys and references, always in the same order, so that a changed schema is a changed text."""
    parts, references = [], []
    for t in LOGICAL:
        lines = [f"  {f.name} {f.dataType.simpleString()}{' [pk]' if f.name == CUBES[t].key else ''}" for f in catalog.table(t).schema.fields]
        parts.append(f"Table {t} {{\n" + "\n".join(lines) + "\n}")
        references += [f"Ref: {t}.{own.strip().removeprefix('$')} > {their.strip().removeprefix('$')}" for j in CUBES[t].joins if j.relationship == "belongs_to" for own, their in [j.on.split("=")]]
    return "\n\n".join(parts) + "\n\n" + "\n".join(references) + "\n"


def dbml_drifted(catalog: Catalog, text: str) -> bool:
    """Whether a stored document isn't what the schema says now."""
    return write_dbml(catalog) != text


def embeddable(catalog: Catalog, without: tuple[str, ...] = ("entity_embeddings",)) -> DataFrame:
    """(schema_name, table_name) of the tables whose content is embedded."""
    return catalog.columns().where(~F.col("table_name").isin(list(without))).select(F.when(F.col("table_name").startswith("ref_"), "ref").otherwise("financial").alias("schema_name"), "table_name").distinct()


def evaluate_contract(catalog: Catalog, contract: dict) -> DataFrame:
    """Assertions of a contract's table from one pass.

    contract: table, quality ({rule: rowCountGreaterThan, value} or {rule: columnNoNulls, column}),
    columns ({name, allowedValues}), uniqueKey.
    """
    rules = contract.get("quality", ())
    more = [r["value"] for r in rules if r["rule"] == "rowCountGreaterThan"]
    filled = tuple(r["column"] for r in rules if r["rule"] == "columnNoNulls")
    allowed = {c["name"]: tuple(c["allowedValues"]) for c in contract.get("columns", ()) if c.get("allowedValues")}
    unique = (contract["uniqueKey"],) if contract.get("uniqueKey") else ()
    return quality.assertions(catalog.table(contract["table"]), contract["table"], (max(more) + 1, 1 << 62) if more else None, filled, unique, allowed)


def search_catalog(catalog: Catalog, question: str, k: int = 5) -> DataFrame:
    """(table_name, fqn, score, description, tags): the k tables whose name and columns have most words of a question."""
    return entity_catalog.search(entity_catalog.entities(catalog), question, k).withColumnRenamed("name", "table_name")
