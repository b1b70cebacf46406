"""Sends this package to the executors, where they don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; does nothing if PYTHONPATH, which workers inherit, names the package's home."""
    app = spark.sparkContext.applicationId
    if app in _SENT or _HOME in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cellmill-"), "cellmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(_HOME, "cellmill")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _HOME))
    spark.sparkContext.addPyFile(path)  # Spark serves it to every executor
    _SENT.add(app)
