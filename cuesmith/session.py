"""Makes the package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="ship-"), "cuesmith.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(home):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("cuesmith", os.path.relpath(full, home)))
        sc.addPyFile(to)
        _SHIPPED.add(sc.applicationId)
    return spark
