"""Puts this package on the Python path of executors that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package as a zip file with the application's jobs, once for each application."""
    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or str(root.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    archive = Path(tempfile.mkdtemp(prefix="sheetweave-ship-")) / "sheetweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
