"""Histories that change streams are applied to: a base in buckets of keys, and changes beside it.

A batch writes its changes and nothing else. A reader applies all changes that lie beside the base
to it at once, so neither the order of batches nor that of changes matters. Compaction folds the
changes up to a cut-over into the base, rewriting only the buckets that have any; changes that come
for a time that is folded are too late and are put aside.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators.temporal import apply_changes
from marlstone.sources.manifest import Manifests

BUCKETS = 16
#: Rows of the changes beside a base, as a share of its own, from which a sink folds them.
FOLD_SHARE = 0.2


class VersionLog:
    """A history (key, columns, valid_from, valid_to, is_active) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.manifests = Manifests(spark, f"{self.folder}/log")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def create(self, history: DataFrame) -> None:
        """Write a history as the base of generation 0."""
        history.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/base-0")
        n = history.count()
        self.manifests.put(0, {"generation": 0, "schema": history.schema.json(), "base": {str(b): "base-0" for b in range(self.buckets)}, "rows": n, "through": -1, "folded": None})

    def _base(self, at: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(at["schema"]))
        paths = [f"{self.folder}/{at['base'][str(b)]}/bucket={b}" for b in (range(self.buckets) if buckets is None else buckets)]
        there = [p for p in paths if self.manifests.exists(p)]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def _changes(self, at: dict) -> DataFrame | None:
        """The changes beside the base: what the last compaction left over, and the batches since."""
        names = [f"rest-{at['generation']}"] if self.manifests.exists(f"{self.folder}/rest-{at['generation']}/_SUCCESS") else []
        names += [f"changes/{n}" for n in self.manifests.children(f"{self.folder}/changes") if int(n.split("=")[1]) > at["through"]]
        parts = [self.spark.read.parquet(f"{self.folder}/{n}") for n in names if self.manifests.exists(f"{self.folder}/{n}/_SUCCESS")]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def append(self, changes: DataFrame, batch: int) -> None:
        """Write a batch of changes (key, cutover, the columns that change); a batch that comes again replaces itself, or is ignored if it's folded.

        Changes with a null key, or for a time that is folded, go to late/batch=N: they have no effect.
        """
        at = self.manifests.last()
        if batch <= at["through"]:
            return
        late = F.col(self.key).isNull() | F.col("cutover").isNull()
        if at["folded"] is not None:
            late = late | (F.col("cutover").cast("timestamp_ntz") <= F.lit(at["folded"]).cast("timestamp_ntz"))
        changes = changes.withColumn("bucket", self._bucket()).persist()
        try:
            changes.where(~late).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")
            if not changes.where(late).isEmpty():
                changes.where(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch}")
        finally:
            changes.unpersist()

    def read(self) -> DataFrame:
        """The history with all changes."""
        at = self.manifests.last()
        changes = self._changes(at)
        base = self._base(at)
        return base if changes is None else apply_changes(base, changes.drop("bucket"), self.key)

    def late(self) -> DataFrame | None:
        names = self.manifests.children(f"{self.folder}/late")
        parts = [self.spark.read.parquet(f"{self.folder}/late/{n}") for n in names]
        return reduce(DataFrame.unionByName, parts).drop("bucket") if parts else None

    def compact(self, until: str | None = None) -> list[int]:
        """Fold the changes up to a cut-over (all, if none is named) into a new generation of the buckets that have any; which they were."""
        at = self.manifests.last()
        changes = self._changes(at)
        if changes is None:
            return []
        time = F.col("cutover").cast("timestamp_ntz")
        until = until or str(changes.agg(F.max(time)).first()[0])
        due = changes.where(time <= F.lit(until).cast("timestamp_ntz"))
        buckets = sorted(r["bucket"] for r in due.select("bucket").distinct().collect())
        n = at["generation"] + 1
        batches = [int(c.split("=")[1]) for c in self.manifests.children(f"{self.folder}/changes")]
        changes.where(time > F.lit(until).cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{self.folder}/rest-{n}")
        if buckets:
            folded = apply_changes(self._base(at, buckets), due.drop("bucket"), self.key)
            folded.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base-{n}")
        body = at | {"generation": n, "base": at["base"] | {str(b): f"base-{n}" for b in buckets}, "through": max([at["through"], *batches]), "folded": max(until, at["folded"] or until)}
        body["rows"] = self._base(body).count()
        self.manifests.put(n, body)
        return buckets

    def vacuum(self) -> None:
        """Remove what neither the present generation nor the one before reads."""
        numbers = self.manifests.numbers()
        if len(numbers) < 2:
            return
        kept = [json.loads("".join(r[0] for r in self.spark.read.text(self.manifests.path(n)).collect())) for n in numbers[-2:]]
        used = {p for m in kept for p in m["base"].values()} | {f"rest-{m['generation']}" for m in kept}
        for name in self.manifests.children(self.folder):
            if name.split("-")[0] in ("base", "rest") and name not in used:
                self.manifests.delete(f"{self.folder}/{name}")
        for name in self.manifests.children(f"{self.folder}/changes"):
            if int(name.split("=")[1]) <= kept[0]["through"]:
                self.manifests.delete(f"{self.folder}/changes/{name}")
        for n in numbers[:-2]:
            self.manifests.delete(self.manifests.path(n))


def sink(log: VersionLog, lateness: str = "1 day", fold_share: float = FOLD_SHARE) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: writes each batch's changes, and folds those older than `lateness` when enough lie beside the base."""

    def write(changes: DataFrame, batch: int) -> None:
        log.append(changes, batch)
        at = log.manifests.last()
        beside = log._changes(at)
        if beside is not None and beside.count() > fold_share * at["rows"]:
            until = beside.agg((F.max(F.col("cutover").cast("timestamp")) - F.expr(f"INTERVAL {lateness}")).cast("timestamp_ntz")).first()[0]
            log.compact(str(until))
            log.vacuum()

    return write
