"""Optional source for HDF5 snapshots; needs h5py, which is imported when a file is read.

    spark.dataSource.register(Hdf5Source)
    spark.read.format("particle_hdf5").option("group", "PartType0").load("snap_000.0.hdf5")
    snapshot(spark, locate("/data/run", 0, "snap"))

Each input partition is one range of rows of one file; a column is read only where the schema asks for it.
"""

from __future__ import annotations

import glob
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..conf import EngineConf
from ..snapshot import Snapshot

ROWS = 1_000_000


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, offset: int):
        self.path, self.first, self.last, self.offset = path, first, last, offset


def paths_of(path: str) -> list[str]:
    """A file, or all files ``name.0.hdf5``, ``name.1.hdf5``... in order of their numbers."""
    found = glob.glob(path) or glob.glob(f"{path}.hdf5") or glob.glob(f"{path}.*.hdf5") or glob.glob(f"{path}/*.hdf5")
    return sorted(found, key=lambda p: (len(p), p))


def locate(folder: str, number: int | None, base: str = "snap", kind: str = "snapdir") -> str:
    """The path of a snapshot (or, with another ``kind`` of folder, of a catalogue): one file, numbered files in a folder of their own, or numbered files side by side."""
    name = base if number is None else f"{base}_{number:03d}"
    for path in (f"{folder}/{name}.hdf5", f"{folder}/{kind}_{number or 0:03d}/{name}", f"{folder}/{name}"):
        if paths_of(path):
            return path
    raise FileNotFoundError(f"no {name} in {folder}")


def metadata(path: str) -> dict[str, dict]:
    """Header, parameters and config of the first file, as plain numbers, strings and lists."""
    import h5py

    out = {}
    with h5py.File(paths_of(path)[0], "r") as f:
        for name in ("Header", "Parameters", "Config"):
            attributes = dict(f[name].attrs) if name in f else {}
            out[name.lower()] = {k: v.decode() if isinstance(v, bytes) else v.tolist() if hasattr(v, "tolist") else v for k, v in attributes.items()}
    return out


def snapshot(spark: SparkSession, path: str, conf: EngineConf | None = None) -> Snapshot:
    """All particle types of a snapshot. Raises where a type has another number of rows than the header says."""
    import h5py

    spark.dataSource.register(Hdf5Source)
    about, rows = metadata(path), {}
    for one in paths_of(path):
        with h5py.File(one, "r") as f:
            for name in f:
                found = re.fullmatch(r"PartType(\d)", name)
                if found and len(f[name]):
                    rows[int(found[1])] = rows.get(int(found[1]), 0) + len(next(iter(f[name].values())))
    for t, n in enumerate(about["header"].get("NumPart_Total", [])):
        if rows.get(t, 0) != n:
            raise ValueError(f"type {t} has {rows.get(t, 0)} rows, the header says {n}")
    types = {t: spark.read.format("particle_hdf5").option("group", f"PartType{t}").load(path) for t in sorted(rows)}
    return Snapshot(types, about["header"], about["parameters"], about["config"], conf)


class Hdf5Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "particle_hdf5"

    def schema(self) -> str:
        import h5py

        fields = ["row_id bigint"]
        for path in paths_of(self.options["path"]):
            with h5py.File(path, "r") as f:
                if self.options["group"] not in f:
                    continue
                for name, data in f[self.options["group"]].items():
                    one = "bigint" if data.dtype.kind in "iu" else "double"
                    if data.ndim == 2:
                        one = f"struct<x:{one},y:{one},z:{one}>" if data.shape[1] == 3 else f"array<{one}>"
                    fields.append(f"`{name}` {one}")
                break
        return ", ".join(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return Hdf5Reader(self.options["path"], self.options["group"], schema)


class Hdf5Reader(DataSourceReader):
    def __init__(self, path: str, group: str, schema: StructType):
        self.path, self.group, self.schema = path, group, schema

    def partitions(self) -> list[InputPartition]:
        import h5py

        out, offset = [], 0
        for path in paths_of(self.path):
            with h5py.File(path, "r") as f:
                n = len(next(iter(f[self.group].values()))) if self.group in f else 0
            out += [_Range(path, a, min(n, a + ROWS), offset) for a in range(0, n, ROWS)]
            offset += n
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        import h5py
        import numpy as np

        with h5py.File(part.path, "r") as f:
            group, columns = f[self.group], []
            for field in self.schema.fields:
                if field.name == "row_id":
                    columns.append(pa.array(np.arange(part.first, part.last) + part.offset))
                    continue
                data = group[field.name][part.first : part.last]
                data = data.astype(np.int64 if data.dtype.kind in "iu" else np.float64)
                if data.ndim == 1:
                    columns.append(pa.array(data))
                elif data.shape[1] == 3:
                    columns.append(pa.StructArray.from_arrays([pa.array(data[:, k]) for k in range(3)], ["x", "y", "z"]))
                else:
                    columns.append(pa.array(list(data)))
        yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema.fields])
