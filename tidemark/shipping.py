"""Let Python workers import this package, on other hosts and from any working directory."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether the driver runs all tasks itself."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def workers_can_import(spark: SparkSession) -> None:
    """Name the package's folder to workers of this host, and on a cluster send the package along, once an application."""
    context = spark.sparkContext
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    if not is_local(spark) and context.applicationId not in _SHIPPED:
        archive = Path(tempfile.mkdtemp()) / "tidemark.zip"  # the driver serves it from here
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted((ROOT / "tidemark").rglob("*.py")):
                out.write(f, f.relative_to(ROOT))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
