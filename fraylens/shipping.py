"""Sends the package to the executors of a session, so that Python stages need no installation there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def archive(folder: str) -> str:
    """Zip of the package's modules in ``folder``; a driver-side file that Spark's own file server hands out."""
    package = Path(__file__).resolve().parent
    target = str(Path(folder) / "fraylens.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, str(Path(package.name) / module.relative_to(package)))
    return target


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        spark.sparkContext.addPyFile(archive(tempfile.mkdtemp(prefix="fraylens-zip-")))
        _SENT.add(app)
