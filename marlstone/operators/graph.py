"""Property graphs as node and edge DataFrames, patterns as joins, closure as recursion."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.bindings import Catalog

# Node labels by table, key and the properties they carry.
NODES: dict[str, tuple[str, str]] = {
    "Party": ("party", "party_id"), "Individual": ("party_individual", "party_id"), "Organization": ("party_organization", "party_id"), "Customer": ("party_role_customer", "party_role_customer_id"),
    "DepositAccount": ("deposit_account", "deposit_account_id"), "DepositBalance": ("deposit_balance", "deposit_balance_id"), "LoanApplication": ("loan_application", "loan_application_id"), "LoanAgreement": ("loan_agreement", "loan_agreement_id"),
    "LoanCollateral": ("loan_collateral", "loan_collateral_id"), "RefCountry": ("ref_country", "country_code"), "RefCurrency": ("ref_currency", "currency_code"), "RefIndustry": ("ref_nace_industry", "nace_code"),
}
# Relationships: source label, its foreign key column (on the node's table), target label; reversed if the target holds the key.
EDGES: tuple[tuple[str, str, str, str, bool], ...] = (
    ("CITIZEN_OF", "Individual", "citizenship_country_code", "RefCountry", False),
    ("OPERATES_IN_INDUSTRY", "Organization", "nace_code", "RefIndustry", False),
    ("PLAYS_ROLE", "Party", "party_id", "Customer", True),
    ("HOLDS_ACCOUNT", "Customer", "customer_id", "DepositAccount", True),
    ("DENOMINATED_IN", "DepositAccount", "currency_code", "RefCurrency", False),
    ("HAS_BALANCE", "DepositAccount", "deposit_account_id", "DepositBalance", True),
    ("APPLIED_FOR", "Customer", "customer_id", "LoanApplication", True),
    ("BORROWER_OF", "Customer", "customer_id", "LoanAgreement", True),
    ("DENOMINATED_IN", "LoanAgreement", "currency_code", "RefCurrency", False),
    ("ORIGINATED", "LoanApplication", "loan_application_id", "LoanAgreement", True),
    ("SECURED_BY", "LoanAgreement", "loan_agreement_id", "LoanCollateral", True),
)


_PROPERTY = re.compile(r"'(?:[^']|'')*'|\bn\d+\.\w+")


class Graph:
    """Active rows as nodes; an edge exists where both its ends do."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def nodes(self, label: str) -> DataFrame:
        table, key = NODES[label]
        df = self.catalog.table(table)
        df = df.where("md_is_active") if "md_is_active" in df.columns else df
        return df.withColumn("node_id", F.col(key))

    def edges(self, kind: str, source: str, column: str, target: str, held_by_target: bool, hint: str | None = None) -> DataFrame:
        """(src, dst): the holder of the foreign key against the keys that are there; hint says how those are joined."""
        holder, other = (target, source) if held_by_target else (source, target)
        held = self.nodes(holder).select(F.col("node_id").alias("own"), F.col(column).alias("their")).where(F.col("their").isNotNull())
        there = self.nodes(other).select(F.col("node_id").alias("their"))
        found = held.join(there.hint(hint) if hint else there, "their", "left_semi")
        return found.select(F.col("their").alias("src"), F.col("own").alias("dst")) if held_by_target else found.select(F.col("own").alias("src"), F.col("their").alias("dst"))

    def edge(self, kind: str, source: str) -> DataFrame:
        return self.edges(*next(e for e in EDGES if e[0] == kind and e[1] == source))

    def match(self, *pattern: str, columns: list[str], where: str | None = None, order: list | None = None, limit: int | None = None) -> DataFrame:
        """A chain Label, EDGE, Label, ...; node properties are named alias.property with aliases n0, n1, ..."""
        named = lambda i: self.nodes(pattern[2 * i]).select(*[F.col(c).alias(f"n{i}__{c}") for c in self.nodes(pattern[2 * i]).columns])
        df = named(0)
        for i in range(1, len(pattern) // 2 + 1):
            kind, source, column, target, by_target = next(e for e in EDGES if e[0] == pattern[2 * i - 1] and e[1] == pattern[2 * i - 2] and e[3] == pattern[2 * i])
            right = named(i)
            on = right[f"n{i}__{column}"] == df[f"n{i - 1}__node_id"] if by_target else df[f"n{i - 1}__{column}"] == right[f"n{i}__node_id"]
            df = df.join(right, on)
        named_here = {f"n{i}.{c}" for i in range(len(pattern) // 2 + 1) for c in self.nodes(pattern[2 * i]).columns}
        plain = lambda e: _PROPERTY.sub(lambda m: m[0].replace(".", "__") if m[0] in named_here else m[0], e)  # noqa: E731  decimals and literals stay
        if where:
            df = df.where(plain(where))
        df = df.select(*[F.expr(plain(value)).alias(name) for value, name in (c.rsplit(" AS ", 1) for c in columns)])
        df = df.orderBy(*order) if order else df
        return df.limit(limit) if limit else df

    def label_inventory(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [self.nodes(label).agg(F.count(F.lit(1)).alias("n_nodes")).select(F.lit(label).alias("label"), "n_nodes") for label in NODES])

    def edge_inventory(self) -> DataFrame:
        """(edge_type, n_edges); each holder of foreign keys is read once for all its edges, its keys against those that are there."""
        parts = []
        for holder in dict.fromkeys(t if by_target else s for _, s, _, t, by_target in EDGES):
            own = [e for e in EDGES if (e[3] if e[4] else e[1]) == holder]
            df = self.nodes(holder).select(*dict.fromkeys(e[2] for e in own))
            marks = []
            for i, (kind, source, column, target, by_target) in enumerate(own):
                there = self.nodes(source if by_target else target).select(F.col("node_id").alias(f"__k{i}")).distinct()
                df = df.join(there, df[column] == there[f"__k{i}"], "left")
                marks.append(F.struct(F.lit(kind).alias("edge_type"), F.count(f"__k{i}").alias("n")))
            parts.append(df.agg(F.array(*marks).alias("m")).select(F.inline("m")))
        return reduce(DataFrame.unionAll, parts).groupBy("edge_type").agg(F.sum("n").alias("n_edges"))

    def totals(self) -> DataFrame:
        """(n_nodes, n_edges) of the whole graph."""
        nodes = self.label_inventory().agg(F.sum("n_nodes").alias("n_nodes"))
        return nodes.crossJoin(self.edge_inventory().agg(F.sum("n_edges").alias("n_edges")))  # one row each

    def degrees(self, label: str, kind: str) -> DataFrame:
        """(node_id, n) of every node of a label: its edges of a kind, 0 if it has none."""
        per = self.edge(kind, label).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
        return self.nodes(label).select("node_id").join(per, "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))

    def labelled(self, has: tuple[str, ...], lacks: tuple[str, ...] = ()) -> DataFrame:
        """(node_id) of nodes that bear all labels of has and none of lacks; labels on one key space are labels of one node."""
        ids = lambda label: self.nodes(label).select("node_id")
        df = ids(has[0])
        for label in has[1:]:
            df = df.join(ids(label), "node_id", "left_semi")
        for label in lacks:
            df = df.join(ids(label), "node_id", "left_anti")
        return df

    def untyped(self, classes: DataFrame) -> DataFrame:
        """(label, node_id) of the nodes that no class (column label) describes."""
        nodes = reduce(DataFrame.unionAll, [self.nodes(x).select(F.lit(x).alias("label"), F.col("node_id").cast("string").alias("node_id")) for x in NODES])
        return nodes.join(F.broadcast(classes.select("label").distinct()), "label", "left_anti")

    def names(self) -> DataFrame:
        """(id, name) of the named nodes; id is label:node."""
        named = (("Individual", ("first_name", "last_name")), ("Organization", ("legal_name",)), ("Customer", ("customer_number",)))
        parts = [self.nodes(x).select(F.concat(F.lit(f"{x}:"), F.col("node_id").cast("string")).alias("id"), F.concat_ws(" ", *cols).alias("name")) for x, cols in named]
        return reduce(DataFrame.unionAll, parts)

    def full_text(self, term: str, k: int = 10) -> DataFrame:
        """(label, node_id, name, score): the k named nodes with most words of a term in their names, exact names first."""
        names = (("Individual", ("first_name", "last_name")), ("Organization", ("legal_name",)), ("Customer", ("customer_number",)))
        asked = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(term)), F.lit("[a-z0-9]+"), F.lit(0)))
        parts = [self.nodes(x).select(F.lit(x).alias("label"), "node_id", F.concat_ws(" ", *cols).alias("name")) for x, cols in names]
        words = F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0))
        scored = reduce(DataFrame.unionAll, parts).withColumn("score", F.size(F.array_intersect(words, asked)).cast("bigint") + (F.lower("name") == term.lower()).cast("bigint"))
        return scored.where("score > 0").orderBy(F.desc("score"), "label", "node_id").limit(k)


def wiped(nodes: DataFrame, label_col: str, own: tuple[str, ...]) -> DataFrame:
    """nodes without those of the labels that a layer owns; other layers' nodes and those without a label stay."""
    return nodes.where(F.col(label_col).isNull() | ~F.col(label_col).isin(list(own)))


def merged(nodes: DataFrame, key: str, tiebreak: str) -> DataFrame:
    """One row for each key, the one with the greatest tiebreak: writing the same nodes twice changes nothing."""
    rest = [c for c in nodes.columns if c != key]
    best = F.max(F.struct(F.col(tiebreak).alias("__t"), *rest)).alias("b")
    return nodes.groupBy(key).agg(best).select(key, *[f"b.{c}" for c in rest]).select(*nodes.columns)


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of all chains of (child, parent) edges, the shortest depth of each pair.

    A chain ends before it comes to a class that it has passed, so cycles end too.
    """
    return spark.sql(
        """WITH RECURSIVE reach(ancestor, descendant, depth, passed) AS (
             SELECT parent, child, 1, array(child, parent) FROM {edges}
             UNION ALL
             SELECT e.parent, r.descendant, r.depth + 1, array_append(r.passed, e.parent) FROM reach r JOIN {edges} e ON e.child = r.ancestor WHERE NOT array_contains(r.passed, e.parent))
           SELECT ancestor, descendant, min(depth) AS depth FROM reach GROUP BY ancestor, descendant""",
        edges=edges,
    )
