"""The HDF5 source, against h5py where it is installed, else against a stand-in with the part of its interface that the source uses."""

from __future__ import annotations

import importlib.util
import pickle
import sys
import textwrap

import numpy as np
import pytest

STAND_IN = """
import pickle


class Group(dict):
    attrs = {}


class File:
    def __init__(self, path, mode="r"):
        with open(path, "rb") as f:
            self.groups = pickle.load(f)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def __iter__(self):
        return iter(self.groups)

    def __contains__(self, name):
        return name in self.groups

    def __getitem__(self, name):
        group = Group(self.groups[name].get("data", {}))
        group.attrs = self.groups[name].get("attrs", {})
        return group
"""


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    """A function that writes groups of arrays and attributes as a file that ``import h5py`` reads."""
    if importlib.util.find_spec("h5py"):
        import h5py

        def real(path, groups):
            with h5py.File(path, "w") as f:
                for name, group in groups.items():
                    g = f.create_group(name)
                    for k, v in group.get("data", {}).items():
                        g[k] = v
                    for k, v in group.get("attrs", {}).items():
                        g.attrs[k] = v

        yield real
        return
    folder = tmp_path_factory.mktemp("stand-in")
    (folder / "h5py.py").write_text(textwrap.dedent(STAND_IN))
    spark.sparkContext.addPyFile(str(folder / "h5py.py"))
    sys.path.insert(0, str(folder))

    def plain(path, groups):
        with open(path, "wb") as f:
            pickle.dump(groups, f)

    yield plain
    sys.path.remove(str(folder))
    sys.modules.pop("h5py", None)


def _groups(first, n, total):
    x = np.arange(first, first + n)
    return {
        "Header": {"attrs": {"Time": np.float64(0.5), "BoxSize": np.float64(10.0), "NumPart_Total": np.array([total, 0, 2]), "MassTable": np.zeros(3)}},
        "Parameters": {"attrs": {"HubbleParam": np.float64(0.7), "ComovingIntegrationOn": np.int32(1), "Name": b"run"}},
        "PartType0": {"data": {"Masses": (x + 1.0).astype(np.float32), "Density": np.full(n, 2.0, np.float32), "Coordinates": np.stack([x, x + 0.5, -x], 1).astype(np.float64), "ParticleIDs": x.astype(np.uint32), "GFM_Metals": np.ones((n, 2), np.float32)}},
        **({"PartType2": {"data": {"Masses": np.ones(2)}}} if first == 0 else {}),
    }


def test_snapshot_over_several_files(spark, write, tmp_path):
    from skyfold.sources import hdf5

    (tmp_path / "snapdir_007").mkdir()
    write(tmp_path / "snapdir_007" / "snap_007.0.hdf5", _groups(0, 5, 12))
    write(tmp_path / "snapdir_007" / "snap_007.1.hdf5", _groups(5, 7, 12))
    path = hdf5.locate(str(tmp_path), 7, "snap")
    snap = hdf5.snapshot(spark, path)
    assert snap.a == 0.5 and snap.h == 0.7 and snap.parameters["Name"] == "run" and sorted(snap.types) == [0, 2]
    rows = snap.types[0].orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [r["ParticleIDs"] for r in rows] == list(range(12))
    assert [tuple(r["Coordinates"]) for r in rows] == [(float(i), i + 0.5, float(-i)) for i in range(12)]
    assert all(r["GFM_Metals"] == [1.0, 1.0] for r in rows)
    volume = snap.frame(0, "0_Volume", extra=["row_id"]).orderBy("row_id").collect()
    assert [r["Volume"] for r in volume] == [(i + 1) / 2 for i in range(12)]
    assert snap.types[2].count() == 2


def test_one_file_and_wrong_counts(spark, write, tmp_path):
    from skyfold.sources import hdf5

    write(tmp_path / "snap_001.hdf5", _groups(0, 4, 4))
    assert hdf5.snapshot(spark, hdf5.locate(str(tmp_path), 1, "snap")).types[0].count() == 4
    write(tmp_path / "snap_002.hdf5", _groups(0, 4, 5))
    with pytest.raises(ValueError):
        hdf5.snapshot(spark, hdf5.locate(str(tmp_path), 2, "snap"))
    with pytest.raises(FileNotFoundError):
        hdf5.locate(str(tmp_path), 3, "snap")
