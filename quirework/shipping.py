"""Hands the package to the executors, for functions that run in Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per context; workers can then import the package wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_quirework_shipped", False):
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="quirework-")) / "quirework.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    sc.addPyFile(str(to))
    sc._quirework_shipped = True
