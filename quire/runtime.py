"""Cutting lineage where several later steps read the same rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TOOL, VERSION = "quire", "0.2.0"


def ensure_folder(spark: SparkSession) -> None:
    """Set the cluster's checkpoint folder; a temporary one only where all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
    sc.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's folder (``spark.checkpoint.dir``)."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)
