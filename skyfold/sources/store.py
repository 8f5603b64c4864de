"""Self-describing folders: one parquet table for each data set and a JSON sidecar with the metadata.

``<folder>/<base>_<NNN>/`` holds ``PartType0.parquet``, ``Group.parquet``, ``Subhalo.parquet`` or tables of any name (``group/name.parquet`` in a group), and
``meta.json`` with header, parameters, config, units by column, and what wrote it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..conf import EngineConf
from ..functions.bins import centers
from ..operators.camera import Camera
from ..snapshot import Snapshot
from ..timeseries import TimeSeries
from ..units import Unit
from . import files

META = "meta.json"


def widened(df: DataFrame) -> DataFrame:
    """Single-precision columns, also inside structs and arrays, as doubles."""

    def wide(kind: str) -> str:
        return kind.replace("float", "double")

    return df.select(*[F.col(f"`{n}`").cast(wide(t)).alias(n) if "float" in t else F.col(f"`{n}`") for n, t in df.dtypes])


def narrowed(df: DataFrame) -> DataFrame:
    """Double columns as single precision."""
    return df.select(*[F.col(f"`{n}`").cast(t.replace("double", "float")).alias(n) if "double" in t else F.col(f"`{n}`") for n, t in df.dtypes])


@dataclass(frozen=True)
class Histogram:
    """A stored histogram: its rows, how it was made, and the edges of its bins by axis."""

    hist: DataFrame
    logscale: bool
    normalize: bool
    colorlabel: str | None = None
    edges: dict[str, np.ndarray] = field(default_factory=dict)

    def centers(self, axis: str) -> np.ndarray:
        """Middles of an axis's bins, geometric where the bins are logarithmic."""
        return centers(self.edges[axis], self.logscale)


class Reader:
    """Any folder of this layout. ``to_physical`` applies to every loader."""

    def __init__(self, spark: SparkSession, folder: str, number: int | None = None, base: str = "data", conf: EngineConf | None = None, to_physical: bool = False):
        self.spark, self.path, self.conf, self.physical = spark, files.numbered(folder, base, number), conf or EngineConf(), to_physical
        self.meta = files.read_json(spark, f"{self.path}/{META}")

    header = property(lambda self: self.meta.get("header", {}))
    parameters = property(lambda self: self.meta.get("parameters", {}))
    config = property(lambda self: self.meta.get("config", {}))

    def tables(self, group: str | None = None) -> list[str]:
        return [n.removesuffix(".parquet") for n in files.names(self.spark, f"{self.path}/{group}" if group else self.path) if n.endswith(".parquet")]

    def load(self, name: str, group: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """One table, widened to doubles; the column projection reaches the scan."""
        where = f"{group}/{name}" if group else name
        df = widened(self.spark.read.parquet(f"{self.path}/{where}.parquet"))
        if self.physical:
            a = float(self.header.get("Time", 1)) if self.parameters.get("ComovingIntegrationOn") else 1.0
            h = float(self.parameters.get("HubbleParam", 1) or 1)
            out = []
            for n, t in df.dtypes:
                unit = self.unit(where, n)
                factor = a ** float(unit.power("a")) * h ** float(unit.power("h")) if unit is not None else 1.0
                out.append((F.col(n) * F.lit(factor)).alias(n) if factor != 1.0 and t == "double" else F.col(f"`{n}`"))
            df = df.select(*out)
        return df.select(*columns) if columns else df

    def unit(self, table: str, column: str) -> Unit | None:
        text = self.meta.get("units", {}).get(f"{table}/{column}")
        return None if text is None else Unit.parse(text)

    def expect_rows(self, name: str) -> None:
        """Raises unless a table has as many rows as the header says (NumPart_Total, in order of types)."""
        want = self.header["NumPart_Total"][int(name.removeprefix("PartType"))]
        have = self.load(name).count()
        if have != want:
            raise ValueError(f"{name} has {have} rows, the header says {want}")

    def snapshot(self) -> Snapshot:
        types = {int(n.removeprefix("PartType")): self.load(n) for n in self.tables() if n.startswith("PartType")}
        units = {f"{k.split('/')[0].removeprefix('PartType')}_{k.split('/')[1]}": u for k, u in self.meta.get("units", {}).items() if k.startswith("PartType")}
        return Snapshot(types, self.header, self.parameters, self.config, self.conf, units)

    def catalog(self) -> Catalog:
        have = self.tables()
        return Catalog(*[self.load(n) if n in have else None for n in ("Group", "Subhalo")], header=self.header, parameters=self.parameters, conf=self.conf)

    def camera(self) -> Camera:
        return Camera.from_description(self.meta["image_info"])

    def derived_image(self, product: str) -> DataFrame:
        """``ATimesB`` over ``B``, split at the last ``Times``."""
        from ..operators.deposit import ratio

        _, _, lower = product.rpartition("Times")
        return ratio(self.load(product), self.load(lower if lower in self.tables() else f"{product.split('_')[0]}_{lower}"))

    def histogram(self) -> Histogram:
        info = self.meta["hist_info"]
        return Histogram(self.load("hist"), info["logscale"], info["normalize"], info["colorlabel"], {k: np.asarray(v, float) for k, v in info.get("edges", {}).items()})

    def series(self, name: str) -> TimeSeries:
        info = self.meta["series"][name]
        return TimeSeries.of(self.load(name), info["unit"], info["h"], info["comoving"])


class Writer:
    """Writes tables next to a copy of the source's metadata.

    Modes: ``w`` writes to a folder of another name that ``finalize`` renames, so that readers see all or nothing; ``a`` adds and refuses to overwrite; ``r+`` may overwrite. Adding needs the same ``Time``.
    """

    def __init__(self, spark: SparkSession, folder: str, base: str, number: int | None = None, mode: str = "w", header: Mapping | None = None, parameters: Mapping | None = None, config: Mapping | None = None):
        if mode not in ("w", "a", "r+"):
            raise ValueError(f"no such mode: {mode}")
        self.spark, self.mode, self.final = spark, mode, files.numbered(folder, base, number)
        self.meta = {"header": dict(header or {}), "parameters": dict(parameters or {}), "config": dict(config or {}), "units": {}, "org_info": {"base": base, "number": number}}
        if mode == "w":
            self.path = f"{self.final}.{uuid.uuid4().hex}.tmp"
        else:
            self.path = self.final
            if files.exists(spark, f"{self.path}/{META}"):
                old = files.read_json(spark, f"{self.path}/{META}")
                if header is not None and old["header"].get("Time") != self.meta["header"].get("Time"):
                    raise ValueError("the folder holds data of another time")
                self.meta = old
        self._check()

    def _check(self) -> None:
        """More checks of what is there already."""

    def write_data(self, name: str, df: DataFrame, units: Mapping[str, str | Unit] | None = None, group: str | None = None) -> None:
        where = f"{group}/{name}" if group else name
        target = f"{self.path}/{where}.parquet"
        if self.mode == "a" and files.exists(self.spark, target):
            raise FileExistsError(f"{where} is there already; mode r+ overwrites")
        df.write.mode("overwrite" if self.mode == "r+" else "errorifexists").parquet(target)
        self.meta["units"] |= {f"{where}/{c}": str(u) for c, u in (units or {}).items()}

    def finalize(self) -> str:
        files.write_json(self.spark, f"{self.path}/{META}", self.meta)
        if self.mode == "w":
            if files.exists(self.spark, self.final):
                files.delete(self.spark, self.final)
            files.rename(self.spark, self.path, self.final)
        return self.final


class ImageWriter(Writer):
    """Images of one camera; adding needs the same centre, widths and direction."""

    def __init__(self, spark: SparkSession, camera: Camera, folder: str, base: str, number: int | None = None, mode: str = "w", **meta):
        self.camera = camera
        super().__init__(spark, folder, base, number, mode, **meta)
        self.meta["image_info"] = camera.describe()

    def _check(self) -> None:
        old = self.meta.get("image_info")
        if old is not None and any(old.get(k) != v for k, v in self.camera.describe().items()):
            raise ValueError("the folder holds images of another camera")

    def save_image(self, name: str, image: DataFrame, unit: str | Unit = "") -> None:
        self.write_data(name, image, {"value": unit})


class TimeSeriesWriter(Writer):
    """Series under a name without a number; all must have the same times."""

    def __init__(self, spark: SparkSession, folder: str, base: str, mode: str = "w"):
        super().__init__(spark, folder, base, None, mode)
        self.meta.setdefault("series", {})

    def save_series(self, name: str, series: TimeSeries, rtol: float = 1e-14) -> None:
        for other in list(self.meta["series"])[:1]:
            old = self.spark.read.parquet(f"{self.path}/{other}.parquet").select(F.col(series.axis).alias("t"))
            new = series.df.select(F.col(series.axis).alias("t"))
            near = F.abs(F.col("o.t") - F.col("n.t")) <= rtol * F.abs(F.col("o.t"))
            ranked = [d.select("t", F.expr("row_number() OVER (ORDER BY t)").alias("r")).alias(k) for d, k in ((old, "o"), (new, "n"))]
            if ranked[0].join(ranked[1], F.col("o.r") == F.col("n.r"), "full").filter(~F.coalesce(near, F.lit(False))).limit(1).count():
                raise ValueError("series in one folder must have the same times")
        self.write_data(name, series.df, {"value": series.unit})
        self.meta["series"][name] = {"unit": str(series.unit), "h": series.h, "comoving": series.comoving}


def save_histogram(spark: SparkSession, hist: DataFrame, folder: str, base: str, number: int | None = None, logscale: bool = False, normalize: bool = False, label: str | None = None, edges: Mapping[str, Sequence[float]] | None = None) -> str:
    """A histogram with how it was made and the ``edges`` of its bins by axis."""
    w = Writer(spark, folder, base, number)
    w.write_data("hist", hist)
    w.meta["hist_info"] = {"logscale": logscale, "normalize": normalize, "colorlabel": label, "edges": {k: [float(x) for x in v] for k, v in (edges or {}).items()}}
    return w.finalize()


def save_snapshot(spark: SparkSession, snap: Snapshot, folder: str, base: str, number: int | None = None, keys: Sequence[str] | None = None, single_precision: bool = False, sort_by_id: bool = True) -> str:
    """The snapshot's rows, or the given keys of them, with counts in the header rewritten.

    Rows are sorted by row id in each file, so that ranges of ids prune row groups.
    """
    w = Writer(spark, folder, base, number, header=snap.header, parameters=snap.parameters, config=snap.config)
    counts: list[int] = []
    for t in sorted(snap.types):
        mine = [k for k in keys or [] if k.startswith(f"{t}_")]
        df = snap.frame(t, *mine, extra=[snap.row_id]) if mine else snap.types[t]
        if keys and not mine:
            continue
        if single_precision:
            df = narrowed(df)
        if sort_by_id and snap.row_id in df.columns:
            df = df.sortWithinPartitions(snap.row_id)
        units = {c: snap.unit(f"{t}_{c}") for c in df.columns if c != snap.row_id}
        w.write_data(f"PartType{t}", df, {c: u for c, u in units.items() if u is not None})
        counts += [0] * (t + 1 - len(counts))
        counts[t] = spark.read.parquet(f"{w.path}/PartType{t}.parquet").count()
    w.meta["header"]["NumPart_Total"] = counts
    return w.finalize()


def save_catalog(spark: SparkSession, catalog: Catalog, folder: str, base: str, number: int | None = None, single_precision: bool = False) -> str:
    """The catalogue's tables, counts in the header rewritten from what was written."""
    w = Writer(spark, folder, base, number, header=catalog.header, parameters=catalog.parameters)
    for table, name, count in (("groups", "Group", "Ngroups_Total"), ("subhalos", "Subhalo", "Nsubhalos_Total")):
        if table in catalog.tables:
            df = catalog.tables[table]
            units = {c: catalog.unit(table, c) for c in df.columns}
            w.write_data(name, narrowed(df) if single_precision else df, {c: u for c, u in units.items() if u is not None})
            w.meta["header"][count] = spark.read.parquet(f"{w.path}/{name}.parquet").count()
    return w.finalize()


class Generic:
    """A snapshot of foreign data: set positions, volumes and columns, then open it."""

    def __init__(self, df: DataFrame, parttype: int = 0, row_id: str = "row_id"):
        self.df, self.t, self.row_id = df, parttype, row_id
        self.header, self.parameters, self.units = {}, {}, {}

    def give_info(self, boxsize: float, hubble: float = 1.0, comoving: bool = False, a: float = 1.0, length_cm: float | None = None, mass_g: float | None = None, velocity_cm_s: float | None = None, **cosmology) -> Generic:
        self.header |= {"BoxSize": boxsize, "Time": a, "Redshift": 1 / a - 1}
        units = {"UnitLength_in_cm": length_cm, "UnitMass_in_g": mass_g, "UnitVelocity_in_cm_per_s": velocity_cm_s}
        self.parameters |= {"HubbleParam": hubble, "ComovingIntegrationOn": int(comoving), **cosmology, **{k: v for k, v in units.items() if v is not None}}
        return self

    def set_data(self, block: str, column, unit: str | None = None) -> Generic:
        self.df = self.df.withColumn(block, column)
        if unit is not None:
            self.units[f"{self.t}_{block}"] = unit
        return self

    def set_positions(self, x, y, z, unit: str = "code_length") -> Generic:
        return self.set_data("Coordinates", F.struct(x.alias("x"), y.alias("y"), z.alias("z")), unit)

    def set_volumes(self, volume, unit: str = "code_length^3") -> Generic:
        return self.set_data("Volume", volume, unit)

    def open(self, conf: EngineConf | None = None) -> Snapshot:
        return Snapshot({self.t: self.df}, self.header, self.parameters, {}, conf, self.units, self.row_id)


