"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a temporary folder that is removed
    when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="guardframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str, path: str | None = None):
    """Write a frame to the shared folder and read it back, which cuts its lineage for good.

    A caller that does this again and again gives a path of its own, whose table is replaced each time.
    """
    path, mode = (path, "overwrite") if path else (scratch_path(df.sparkSession, name), "errorifexists")
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
