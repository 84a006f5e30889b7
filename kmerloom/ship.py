"""Sending this package to the executors, as ``spark-submit --py-files`` would."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that functions pickled by reference are found there."""
    sc = spark.sparkContext
    if getattr(sc, "_kmerloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="kmerloom-"), "kmerloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"kmerloom/{p.relative_to(package)}")
    sc.addPyFile(out)
    sc._kmerloom_shipped = True
