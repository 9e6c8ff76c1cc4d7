"""Reliable checkpoints in the folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready_checkpoints(spark: SparkSession) -> str:
    """Use the folder in spark.checkpoint.dir. Where none is set, a local session gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quarry-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Written once to the shared folder; lineage and plan end there."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
