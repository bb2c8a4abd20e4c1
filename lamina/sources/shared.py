"""Working folders that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, removed when the program ends; on a local master, as in tests, one of our own will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = tempfile.mkdtemp(prefix="lamina-work-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by then
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)

    atexit.register(clear)
    return path
