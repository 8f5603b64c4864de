"""Helpers that every operator of this package shares: lineage cuts, block counts, whole tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate results on whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Remove the files of a ``cut`` that no later plan reads."""
    leaves = df._jdf.queryExecution().logical().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            folder = leaf.rdd().getCheckpointFile()
            if folder.isDefined():
                remove(df.sparkSession, folder.get())


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, 0 for none."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("n")).first()["n"]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(spark: SparkSession, n_bytes: int, block_bytes: int) -> int:
    """Blocks of about ``block_bytes``, and no fewer than two for each shuffle partition."""
    return max(2 * shuffle_width(spark), math.ceil(n_bytes / block_bytes))
