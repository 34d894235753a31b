"""Make this package importable in Python workers wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="quillspark-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
