"""The folder that all machines of a session share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder that was set; a temporary folder only where all runs on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="skyfold-checkpoint-")
    if folder and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder or sc.getCheckpointDir()
