"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import SearchError


def shared_root(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where it is unset and all is one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise SearchError("spark.checkpoint.dir isn't set: the executors need a folder that they all share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkseek-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")
