"""Graph patterns step by step: forward and backward, optional, and over several hops.

A step of one hop joins by the foreign key that makes the edge. Steps of several hops go over the
stored edges: a frontier of nodes moves on hop by hop, and a node that was met before isn't met
again, so cycles end. What a pattern returns is masked by what it is made from and capped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graph import EDGES, NODES, Graph
from marlstone.plans.guarded import Rejected, masked, personal
from marlstone.plans.provenance import Provenance
from marlstone.session import shared_dir
from marlstone.sources.manifest import Manifests

#: Records that an ad-hoc pattern returns at most, and hops that one step may take.
RECORD_CAP, MOST_HOPS = 10, 8
#: Edges that one task of a hop joins, about; the edges of a node that has more are dealt to several tasks.
TASK_ROWS = 500_000
_NAMED = re.compile(r"'(?:[^']|'')*'|\b[A-Za-z_]\w*\.\w+")


class StoredGraph:
    """Nodes and edges of a catalog's tables, written once in the shared folder and used until the tables change."""

    def __init__(self, graph: Graph):
        self.graph, self.spark = graph, graph.catalog.spark
        state = graph.catalog.state({t for t, _ in NODES.values()})
        readable = all(graph.catalog.may_read(t) for t, _ in NODES.values())
        self.folder = f"{shared_dir(self.spark)}/graph/{state[:24]}{'' if readable else '-' + str(graph.catalog.role)}"
        self.files = Manifests(self.spark, self.folder)

    def build(self) -> StoredGraph:
        """Write what isn't there: nodes (label, node_id) by label, edges (kind, src_label, src, dst_label, dst) by kind.

        Each label and each kind is written by itself: dealing rows to folders would sort each task's
        whole share first. Many keys are hashed, each task its own, so that the rows that hold them
        aren't sorted either.
        """
        for label in NODES:
            self._write(f"nodes/label={label}", lambda: self.graph.nodes(label).select(F.col("node_id").cast("string").alias("node_id")))
        for kind in dict.fromkeys(e[0] for e in EDGES):
            self._write(f"edges/kind={kind}", lambda: reduce(DataFrame.unionAll, [self._edges(*e) for e in EDGES if e[0] == kind]))
        return self

    def _write(self, part: str, rows: Callable[[], DataFrame]) -> None:
        if not self.files.exists(f"{self.folder}/{part}/_SUCCESS"):
            rows().write.mode("overwrite").parquet(f"{self.folder}/{part}")

    def _edges(self, kind: str, source: str, column: str, target: str, held_by_target: bool) -> DataFrame:
        many = self.nodes().where(F.col("label") == (source if held_by_target else target)).count() > TASK_ROWS
        found = self.graph.edges(kind, source, column, target, held_by_target, "shuffle_hash" if many else None)
        return found.select(F.lit(source).alias("src_label"), F.col("src").cast("string").alias("src"), F.lit(target).alias("dst_label"), F.col("dst").cast("string").alias("dst"))

    def nodes(self) -> DataFrame:
        return self.spark.read.schema("node_id string, label string").parquet(f"{self.folder}/nodes")

    def edges(self, kinds: tuple[str, ...] = (), direction: str = "out") -> DataFrame:
        """(src_label, src, dst_label, dst) of some kinds; 'in' turns them round, 'both' has each twice."""
        stored = self.spark.read.schema("src_label string, src string, dst_label string, dst string, kind string").parquet(f"{self.folder}/edges")
        stored = (stored.where(F.col("kind").isin(list(kinds))) if kinds else stored).select("src_label", "src", "dst_label", "dst")
        turned = stored.select(F.col("dst_label").alias("src_label"), F.col("dst").alias("src"), F.col("src_label").alias("dst_label"), F.col("src").alias("dst"))
        return {"out": stored, "in": turned, "both": stored.unionByName(turned)}[direction]

    def reach(self, starts: DataFrame, most: int, least: int = 1, kinds: tuple[str, ...] = (), direction: str = "out") -> DataFrame:
        """(start_label, start, label, node_id, hops) of the nodes that least to most hops lead to, by the fewest hops.

        starts has label and node_id. A start isn't reached from itself. Each hop joins the nodes
        met last with the edges; of the ways to a node the shortest stays. The edges are dealt to as
        many tasks as their number asks for, so that what one task sorts doesn't grow with them.
        """
        if not 1 <= least <= most <= MOST_HOPS:
            raise ValueError(f"hops must lie between 1 and {MOST_HOPS}")
        edges, node = self.edges(kinds, direction), ["start_label", "start", "label", "node_id"]
        rows = edges.count()
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
        hubs = _hubs(edges, rows)
        here, there = ("label", "node_id", "part"), ("src_label", "src", "src_part")
        here, there = (here, there) if hubs is not None else (here[:2], there[:2])  # an equal constant on both sides wouldn't be a key of the join
        edges = _dealt(edges, hubs, there, F.pmod(F.xxhash64("dst_label", "dst"), "parts").cast("int")).repartition(tasks, *there)
        first = starts.select(F.col("label").alias("start_label"), F.col("node_id").cast("string").alias("start")).distinct()
        met = first.select("*", F.col("start_label").alias("label"), F.col("start").alias("node_id"), F.lit(0).alias("hops"))
        for hop in range(1, most + 1):
            frontier = _dealt(met.where(F.col("hops") == hop - 1), hubs, here, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(tasks, *here)
            on = reduce(Column.__and__, [F.col(x) == F.col(y) for x, y in zip(here, there, strict=True)])
            moved = frontier.join(edges, on).select("start_label", "start", F.col("dst_label").alias("label"), F.col("dst").alias("node_id"), F.lit(hop).alias("hops"))
            met = met.unionByName(moved).repartition(tasks, *node).groupBy(*node).agg(F.min("hops").alias("hops"))
        return met.where(F.col("hops").between(least, most))


def _hubs(edges: DataFrame, rows: int) -> DataFrame | None:
    """(hub_label, hub, parts) of the sources with more than TASK_ROWS of all rows edges, or None; they are rows / TASK_ROWS at most."""
    if rows <= TASK_ROWS:
        return None
    # Every source with that share is among the frequent items; which of those have it is counted.
    frequent = edges.select(F.struct("src_label", "src").alias("k")).stat.freqItems(["k"], max(TASK_ROWS / rows, 1e-4)).select(F.inline("k_freqItems"))
    counted = edges.join(F.broadcast(frequent), ["src_label", "src"]).groupBy("src_label", "src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS)
    found = [(r["src_label"], r["src"], -(-r["n"] // TASK_ROWS)) for r in counted.collect()]
    return edges.sparkSession.createDataFrame(found, "hub_label string, hub string, parts int") if found else None


def _dealt(rows: DataFrame, hubs: DataFrame | None, keys: tuple[str, ...], part: Column) -> DataFrame:
    """If there are hubs, rows with the last of keys: 0, or at a hub what `part` makes of its number of parts."""
    if hubs is None:
        return rows
    label, node, name = keys
    found = rows.join(F.broadcast(hubs), (F.col(label) == F.col("hub_label")) & (F.col(node) == F.col("hub")), "left")
    return found.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(name, part).drop("hub_label", "hub", "parts")


class Pattern:
    """A pattern that begins at a label; steps add nodes, whose properties are named alias.property."""

    def __init__(self, graph: Graph, alias: str, label: str):
        self.graph, self.at, self.labels, self.columns = graph, alias, {alias: label}, set()
        self.df = self._named(alias, label)

    def _named(self, alias: str, label: str) -> DataFrame:
        if label not in NODES:
            raise ValueError(f"unknown label: {label}")
        rows = self.graph.nodes(label)
        self.columns |= {f"{alias}.{c}" for c in rows.columns}
        return rows.select(*[F.col(c).alias(f"{alias}__{c}") for c in rows.columns])

    def _plain(self, expression: str) -> str:
        return _NAMED.sub(lambda m: m[0].replace(".", "__") if m[0] in self.columns else m[0], expression)

    def out(self, kind: str, alias: str, label: str, hops: tuple[int, int] = (1, 1), optional: bool = False, begin: str | None = None) -> Pattern:
        """A step along edges of a kind, from the last node or from `begin`; optional: what has no such node stays, with nulls."""
        return self._step(kind, alias, label, hops, optional, begin, "out")

    def into(self, kind: str, alias: str, label: str, hops: tuple[int, int] = (1, 1), optional: bool = False, begin: str | None = None) -> Pattern:
        """A step against edges of a kind."""
        return self._step(kind, alias, label, hops, optional, begin, "in")

    def _step(self, kind: str, alias: str, label: str, hops: tuple[int, int], optional: bool, begin: str | None, direction: str) -> Pattern:
        here = begin or self.at
        if alias in self.labels or here not in self.labels:
            raise ValueError(f"node {alias} is named twice, or {here} not at all")
        own, right, how = self.labels[here], self._named(alias, label), "left" if optional else "inner"
        if hops == (1, 1):
            source, target = (own, label) if direction == "out" else (label, own)
            edge = next((e for e in EDGES if (e[0], e[1], e[3]) == (kind, source, target)), None)
            if edge is None:
                raise ValueError(f"no edge {kind} from {source} to {target}")
            holder_is_target = edge[4]
            held_here = (direction == "out") != holder_is_target
            on = F.col(f"{here}__{edge[2]}") == F.col(f"{alias}__node_id") if held_here else F.col(f"{alias}__{edge[2]}") == F.col(f"{here}__node_id")
            self.df = self.df.join(right, on, how)
        else:
            starts = self.df.select(F.lit(own).alias("label"), F.col(f"{here}__node_id").alias("node_id")).where("node_id is not null")
            met = StoredGraph(self.graph).build().reach(starts, hops[1], hops[0], (kind,) if kind else (), direction).where(F.col("label") == label)
            pairs = met.select(F.col("start").alias(f"{alias}__from"), F.col("node_id").alias(f"{alias}__to"), F.col("hops").alias(f"{alias}__hops"))
            self.columns.add(f"{alias}.hops")
            right = pairs.join(right, F.col(f"{alias}__to") == F.col(f"{alias}__node_id").cast("string"))
            self.df = self.df.join(right, F.col(f"{here}__node_id").cast("string") == F.col(f"{alias}__from"), how)
        self.labels[alias], self.at = label, alias
        return self

    def where(self, condition: str) -> Pattern:
        self.df = self.df.where(self._plain(condition))
        return self

    def rows(self, columns: list[str], order: list[str] = (), cap: int | None = RECORD_CAP) -> DataFrame:
        """Columns ('c.name AS name'), at most cap records of them, masked; patterns whose conditions or order ask for personal data are refused."""
        named = [c.rsplit(" AS ", 1) for c in columns]
        df = self.df.select(*[F.expr(self._plain(value)).alias(name) for value, name in named])
        ordered = df.orderBy(*order) if order else df
        origin = Provenance(ordered)
        if personal(origin.conditions()):
            raise Rejected("records can't be chosen, matched or ordered by personal data")
        found = masked(ordered, origin=origin)
        return found.limit(cap) if cap is not None else found
