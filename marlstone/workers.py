"""The package in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_marlstone_shipped", False):
        package = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp()}/{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(archive)
        sc._marlstone_shipped = True
