"""The folder for work that is cut off from its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of our own where it is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or "local-cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="notewright-"))
        folder = _own[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
