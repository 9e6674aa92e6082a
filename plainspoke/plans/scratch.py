"""Folders for what a query writes on the way: below the folder that all executors share, removed when the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; below a temporary folder in local mode where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plainspoke-")
    path = f"{root.rstrip('/')}/plainspoke/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may already be gone
        pass
