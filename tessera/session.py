"""Spark session helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they need no install."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one all executors share, as spark.checkpoint.dir names it; in the
    warehouse, which they share too, where that is unset."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named}/tessera-{context.applicationId}"
