"""Brings this package to Python workers that can't import it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as tmp:
        copy = Path(tmp) / "pack" / root.name
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
        name = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", copy.parent)
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
