"""Folders that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path below spark.checkpoint.dir; a local session without it gets a temporary folder of its machine, and on a
    cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
