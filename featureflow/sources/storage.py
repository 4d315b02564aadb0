"""Shared scratch space for checkpoints and intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# With it a query's shuffle files go when it ends.
FREED_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary folder only for a local master."""
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="featureflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows and their partitioning outlive any executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint whose shuffle files go with it; otherwise they stay until the driver's garbage collection."""
    spark = df.sparkSession
    checkpoint_root(spark)
    before = spark.conf.get(FREED_KEY, "false")
    spark.conf.set(FREED_KEY, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, as the setting is read when one is made
    finally:
        spark.conf.set(FREED_KEY, before)
