"""Folders for tables that a session writes for itself."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session shares (spark.checkpoint.dir); only local sessions without one get
    a temporary folder, which goes with the process."""
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="corvane-index-")
            atexit.register(shutil.rmtree, _local, True)
        root = f"file://{_local}"
    return f"{root.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex[:12]}"
