"""Folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of this machine that goes at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(context, "_corpusloom_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="corpusloom-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context._corpusloom_shared = own
    return f"file://{own}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one store of this application; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, weakref.ref(spark), path)
    return path


def _remove(session, path: str) -> None:
    spark = session()
    if spark is None or spark.sparkContext._jsc is None:  # the session is gone; the folder is left to the cluster's own clean-up
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # nor is a driver that ends held up by it
        pass
