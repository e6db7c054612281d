"""Make the package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the job's Python files once, unless PYTHONPATH already has it."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "scriptorium"), "zip", root, "scriptorium")
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
