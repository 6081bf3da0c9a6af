"""Sends this package to the Python workers, so that a session needs no PYTHONPATH on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip file to the session's context, once per context."""
    context = spark.sparkContext
    if getattr(context, "_keylattice_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    fd, name = tempfile.mkstemp(prefix="keylattice-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(name)

    context._keylattice_shipped = True
    return spark
