"""Making the package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package's source to every executor, once an application; Spark serves the file from the driver."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
