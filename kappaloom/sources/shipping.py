"""Makes the library importable for the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once for each application; they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="kappaloom-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
        if (pipeline := package.parent / "corpus_pipeline.py").exists():
            out.write(pipeline, pipeline.name)
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
