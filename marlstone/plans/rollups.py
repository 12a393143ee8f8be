"""Stored roll-ups that know what they were made from.

A roll-up is stored as partial states: for each value of its dimensions the number of rows, and for
each measure what adds up (counts, exact sums, and how many values a sum has). So a batch of changes
can be merged into it: the states of the new images are added and those of the old ones taken away,
without reading the rows that didn't change.

Beside each version lies a manifest with the state of the source tables that it covers and the
last batch that is in it. A version is written before its manifest, which is put in place by one
rename, so readers see whole versions only and a batch that is retried counts once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.model import CUBES
from marlstone.sources.bindings import Catalog, Overlay
from marlstone.sources.manifest import Manifests

#: Versions that stay: readers of the last but one may not have ended.
KEPT = 2


class Stale(RuntimeError):
    pass


class Rollups:
    """Roll-ups in a folder that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _home(self, cube: str, name: str) -> str:
        return f"{self.folder}/{cube}.{name}"

    def manifest(self, spark: SparkSession, cube: str, name: str) -> dict | None:
        """What the present version covers: version, state, watermark."""
        return Manifests(spark, self._home(cube, name)).last()

    def _write(self, spark: SparkSession, cube: str, name: str, states: DataFrame, state: str, watermark: int | None) -> None:
        home = Manifests(spark, self._home(cube, name))
        versions = home.numbers()
        n = versions[-1] + 1 if versions else 0
        states.write.mode("overwrite").parquet(f"{home.folder}/data-{n:08d}")
        home.put(n, {"version": n, "state": state, "watermark": watermark})
        for old in versions[: 1 - KEPT]:
            home.delete(home.path(old))
            home.delete(f"{home.folder}/data-{old:08d}")

    # What is stored.

    @staticmethod
    def _add(states: DataFrame, dimensions: list[str]) -> DataFrame:
        """States of equal dimensions added up; groups without rows go, sums without values are null."""
        sums = states.groupBy(*dimensions).agg(*[F.sum(c).alias(c) for c in states.columns if c not in dimensions])
        whole = [F.when(F.col(f"{c}__n") > 0, F.col(c)).cast(states.schema[c].dataType).alias(c) if f"{c}__n" in states.columns else F.col(c).cast(states.schema[c].dataType).alias(c) for c in states.columns if c not in dimensions]
        return sums.where(F.col("__rows") > 0).select(*dimensions, *whole)

    def store(self, catalog: Catalog, cube: str, name: str, watermark: int | None = None) -> None:
        """Make a roll-up from its tables."""
        from marlstone.plans.semantic import SemanticLayer

        layer = SemanticLayer(catalog)
        self._write(catalog.spark, cube, name, layer.partials(cube, name), catalog.state(layer.rollup_tables(cube, name)), watermark)

    def fresh(self, catalog: Catalog, cube: str, name: str) -> bool:
        """Whether the stored version covers the tables as they are."""
        from marlstone.plans.semantic import SemanticLayer

        found = self.manifest(catalog.spark, cube, name)
        return found is not None and found["state"] == catalog.state(SemanticLayer(catalog).rollup_tables(cube, name))

    def ensure(self, catalog: Catalog, cube: str, name: str) -> bool:
        """Store the roll-up anew if it's stale; whether it was."""
        stale = not self.fresh(catalog, cube, name)
        if stale:
            self.store(catalog, cube, name)
        return stale

    def read(self, catalog: Catalog, cube: str, name: str) -> DataFrame | None:
        """The present version, if the catalog's role may read all tables behind it and it covers them as they are; else None."""
        from marlstone.plans.semantic import SemanticLayer

        spark, tables = catalog.spark, SemanticLayer(catalog).rollup_tables(cube, name)
        if not all(catalog.may_read(t) for t in tables):
            return None
        found = self.manifest(spark, cube, name)
        if found is None or found["state"] != catalog.state(tables):
            return None
        return spark.read.parquet(f"{self._home(cube, name)}/data-{found['version']:08d}")

    def merge(self, cube: str, name: str, table: str, changes: DataFrame, before: Catalog, after: Catalog, watermark: int) -> bool:
        """Merge changes of one table into the stored version; False if the batch was in it before.

        changes has the table's columns and op: 'delete' rows are images as they were, 'insert'
        rows as they are; an update is one of each. table is the roll-up's own or one that it joins
        directly. before and after are the tables without and with the changes: a version that
        doesn't cover `before` is refused (Stale), since what it lacks can't be told.
        """
        from marlstone.plans.semantic import SemanticLayer

        spark = after.spark
        found = self.manifest(spark, cube, name)
        if found is not None and found["watermark"] is not None and found["watermark"] >= watermark:
            return False
        tables = SemanticLayer(after).rollup_tables(cube, name)
        if table not in tables:
            raise ValueError(f"{cube}.{name} isn't made from {table}")
        if found is None or found["state"] != before.state(tables):
            raise Stale(f"the stored version of {cube}.{name} doesn't cover the tables before the batch")
        only = None
        if table != cube:
            join = next((j for j in CUBES[cube].joins if j.to == table), None)
            keys = re.match(r"\$(\w+) = \$\w+\.(\w+)", join.on) if join else None
            if keys is None:
                raise ValueError(f"{cube} doesn't join {table} directly")
            only = (keys[1], changes.select(F.col(keys[2]).alias(keys[1])).distinct())

        def images(op: str) -> DataFrame:
            rows = changes.where(F.col("op") == op).drop("op")
            return SemanticLayer(Overlay(after, {table: rows}, op)).partials(cube, name, only)

        old = images("delete")
        dimensions = [d.replace(".", "_") for d in CUBES[cube].rollups[name][1]]
        gone = old.select(*[F.col(c) if c in dimensions else (-F.col(c)).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        stored = spark.read.parquet(f"{self._home(cube, name)}/data-{found['version']:08d}")
        states = stored.unionByName(images("insert")).unionByName(gone)
        self._write(spark, cube, name, self._add(states, dimensions), after.state(tables), watermark)
        return True


def sink(rollups: Rollups, cube: str, name: str, table: str, states: Callable[[int], tuple[Catalog, Catalog]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch of changes of a table; states gives the tables before and after a batch."""

    def write(changes: DataFrame, batch: int) -> None:
        changes = changes.persist()  # read for old images, new images and keys
        try:
            rollups.merge(cube, name, table, changes, *states(batch), watermark=batch)
        finally:
            changes.unpersist()

    return write


def refresher(rollups: Rollups, catalog: Catalog, every: str = "1 hour") -> tuple[Callable[[DataFrame, int], None], dict[str, str]]:
    """A foreachBatch function, and its trigger, that store anew each roll-up that has gone stale."""

    def write(_: DataFrame, batch: int) -> None:
        for cube in CUBES.values():
            for name in cube.rollups:
                rollups.ensure(catalog, cube.name, name)

    return write, {"processingTime": every}
