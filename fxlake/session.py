"""Make the package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, as spark-submit --py-files would. Once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_fxlake_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "fxlake.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, path.relative_to(top.parent))
    context.addPyFile(target)
    context._fxlake_shipped = True
