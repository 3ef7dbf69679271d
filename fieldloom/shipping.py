"""Executors get this package from the driver, so that Python functions find it whatever their paths are."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's source files to all executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_fieldloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fieldloom-code-")) / "fieldloom_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))  # the driver serves it to executors
    context._fieldloom_shipped = True
