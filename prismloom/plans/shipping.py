"""Executors run this package's functions: give it to them where they don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    _done.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():
        path = Path(tempfile.mkdtemp(prefix="prismloom-")) / "prismloom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, Path(package.name) / source.relative_to(package))
        context.addPyFile(str(path))
