"""Sends this package to the executors, which need it for their Python functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package, once for each Spark context, as a file that executors fetch. They then need
    neither a shared folder with the code nor a PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corpusloom-code-")  # the driver's own; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    where = Path(folder) / "corpusloom.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
        for path in sorted(root.parent.glob("corpus_pipeline.py")):
            out.write(path, path.name)
    context.addPyFile(str(where))
    context._corpusloom_shipped = True
