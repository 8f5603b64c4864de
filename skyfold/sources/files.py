"""Paths and small files through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    _, q = _fs(spark, target)
    if not fs.rename(p, q):
        raise OSError(f"can't rename {source} to {target}")


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(data, indent=1, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row["value"])


def split_name(path: str) -> tuple[str, str, int | None]:
    """Folder, base name and three-digit number of ``folder/base_NNN``; the number is None where there is none."""
    folder, _, last = path.rstrip("/").rpartition("/")
    last = re.sub(r"\.(?:hdf5|parquet)$", "", last)
    m = re.fullmatch(r"(.*)_(\d{3})", last)
    return (folder, m[1], int(m[2])) if m else (folder, last, None)


def numbered(folder: str, base: str, number: int | None) -> str:
    return f"{folder}/{base}" if number is None else f"{folder}/{base}_{number:03d}"
