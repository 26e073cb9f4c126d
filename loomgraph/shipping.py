"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: Spark itself serves a zip of the package to the workers."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / f"{top.name}_workers.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _done.add(app)
