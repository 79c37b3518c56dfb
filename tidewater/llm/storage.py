"""Places that the driver and all executors share: the folder named in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, also set as the context's checkpoint folder.

    Where neither the setting nor a checkpoint folder exists, local runs and tests get a folder of this machine's own;
    on a cluster every machine would see another one, so that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidewater-checkpoints-")
    sc.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished jobs that nothing refers to any more: its cleaner waits for the
    driver to collect its garbage, which it may not do for long."""
    for _ in range(4):  # what one round frees in Python a later one finds free in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def settled(df: DataFrame, kind: str) -> DataFrame:
    """The frame, written as Parquet below the shared folder and read again: compact, columnar, and exact sizes
    for the planner."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
