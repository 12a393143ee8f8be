"""Numbered manifests in a shared folder: each is put in place by one rename, so readers see whole ones only."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    pass


class Manifests:
    """The manifests of a folder, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def numbers(self) -> list[int]:
        fs, home = self._at(self.folder)
        if not fs.exists(home):
            return []
        found = (re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(home))
        return sorted(int(m[1]) for m in found if m)

    def path(self, n: int) -> str:
        return f"{self.folder}/manifest-{n:08d}.json"

    def last(self) -> dict | None:
        """The manifest of the greatest number, or None."""
        numbers = self.numbers()
        return json.loads("".join(r[0] for r in self.spark.read.text(self.path(numbers[-1])).collect())) if numbers else None

    def put(self, n: int, body: dict) -> None:
        """Write manifest n; raises Conflict if another writer has."""
        fs, draft = self._at(f"{self.folder}/_draft-{n:08d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if not fs.rename(draft, self._at(self.path(n))[1]):
            raise Conflict(f"another writer has made version {n} of {self.folder}")

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def children(self, path: str) -> list[str]:
        """Names within a folder; none if it isn't there."""
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
