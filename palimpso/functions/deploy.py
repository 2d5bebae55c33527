"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_code(spark: SparkSession) -> None:
    """Add the package as a zip to the session's Python files; once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpso_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="palimpso-code-"), "palimpso.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("palimpso", os.path.relpath(full, PACKAGE)))
    sc.addPyFile(target)
    sc._palimpso_shipped = True
