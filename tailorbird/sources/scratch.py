"""Folders that driver and executors share, for what a run writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, as in tests, one of our own, on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        named = _own[app]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
