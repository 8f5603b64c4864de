"""Group and subhalo catalogues, and the rows of a snapshot that belong to one object."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conf import EngineConf
from .snapshot import Snapshot
from .unit_rules import unit_for
from .units import Unit


class Catalog:
    """Two tables, ``groups`` and ``subhalos``, each optional, with the metadata of the run."""

    def __init__(self, groups: DataFrame | None, subhalos: DataFrame | None = None, header: Mapping | None = None, parameters: Mapping | None = None, conf: EngineConf | None = None):
        self.tables = {k: v for k, v in (("groups", groups), ("subhalos", subhalos)) if v is not None}
        self.header, self.parameters, self.conf = dict(header or {}), dict(parameters or {}), conf or EngineConf()

    @property
    def groups(self) -> DataFrame:
        return self.tables["groups"]

    @property
    def subhalos(self) -> DataFrame:
        return self.tables["subhalos"]

    def first_file(self, file_column: str = "file_no") -> Catalog:
        """The rows of the first file alone, where the most massive groups are."""
        new = Catalog(None, None, self.header, self.parameters, self.conf)
        new.tables = {k: v.filter(F.col(file_column) == 0) if file_column in v.columns else v for k, v in self.tables.items()}
        return new

    def unit(self, table: str, column: str) -> Unit | None:
        comoving = bool(self.parameters.get("ComovingIntegrationOn", 0))
        return self.conf.user_units.get((table, column)) or unit_for(table, column, comoving, float(self.parameters.get("HubbleParam", 1) or 1))

    def info(self) -> dict[str, dict[str, list[str]]]:
        """Columns of each table, parted by whether a unit is known."""
        return {t: {"with_unit": [c for c in df.columns if self.unit(t, c) is not None], "without_unit": [c for c in df.columns if self.unit(t, c) is None]} for t, df in self.tables.items()}


def with_offsets(objects: DataFrame, object_id: str, length: str, blocks: int = 64) -> DataFrame:
    """Adds ``first`` and ``last`` (exclusive): the running sum of lengths in the order of ids.

    Two levels: sums of id ranges, then a window in each range, so that no task sorts the whole catalogue.
    """
    ends = objects.agg(F.min(object_id).alias("lo"), F.max(object_id).alias("hi")).first()
    lo, width = ends["lo"] or 0, max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // blocks))
    dealt = objects.withColumn("__b", F.floor((F.col(object_id) - F.lit(lo)) / F.lit(width)))
    sums = dealt.groupBy("__b").agg(F.sum(length).cast("long").alias("__s"))
    base = sums.withColumn("__base", F.sum("__s").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__s")).select("__b", "__base")
    own = F.sum(length).over(Window.partitionBy("__b").orderBy(object_id))
    out = dealt.withColumn("__own", own).join(F.broadcast(base), "__b")  # at most ``blocks`` rows
    last = (F.col("__base") + F.col("__own")).cast("long")
    return out.withColumn("last", last).withColumn("first", (F.col("last") - F.col(length)).cast("long")).drop("__b", "__base", "__own")


def rows_of(snap: Snapshot, parttype: int, first: int, length: int) -> Snapshot:
    """The rows of one object by its offset and length, a range of row ids that reaches the scan; length zero gives none."""
    return snap.select(parttype, (F.col(snap.row_id) >= first) & (F.col(snap.row_id) < first + length))


def joined(particles: DataFrame, objects: DataFrame, object_id: str, row_id: str = "row_id", bucket: int = 4096) -> DataFrame:
    """Particles with the id of the object whose range [first, last) holds their row id.

    An equi-join on buckets of row ids: an object meets the buckets that its range touches.
    """
    spans = objects.filter("last > first").select(F.col(object_id).alias("object_id"), "first", "last")
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("last") - 1) / bucket))))
    own = particles.withColumn("__b", F.floor(F.col(row_id) / bucket))
    inside = (F.col(row_id) >= F.col("first")) & (F.col(row_id) < F.col("last"))
    return own.join(spans, "__b").filter(inside).drop("__b", "first", "last")


def heaviest(objects: DataFrame, mass: Column, k: int, tie: Column) -> DataFrame:
    """The k most massive objects."""
    return objects.orderBy(mass.desc(), tie).limit(k)
