"""Ships the package to executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file to the application, once; local sessions share the driver's files and need none."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or context.master.startswith("local[") or context.master == "local":
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="chronoweave-ship-")
    path = os.path.join(folder, "chronoweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("chronoweave", os.path.relpath(full, package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
