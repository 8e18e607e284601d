"""Brings this package's code to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors a zip of this package, once per application.

    Workers then import the same code as the driver, whatever folder they were started in and whether or not
    PYTHONPATH names it.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(package)
    _shipped[app] = path = os.path.join(tempfile.mkdtemp(prefix="sluice-code-"), "sluice_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, top))
    spark.sparkContext.addPyFile(path)
