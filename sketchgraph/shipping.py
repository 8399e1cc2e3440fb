"""Gives the executors this package, where they don't have it installed."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package's sources to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="sketchgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "sketchgraph.zip")
    Path(name).write_bytes(data.getvalue())
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)
