"""Makes the package importable in Python workers of sessions that were started without it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session: unless PYTHONPATH has the package's folder, its sources go to the workers as a zip file."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _done or root.parent in paths:
        return
    _done.add(app)
    at = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))


def shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run
