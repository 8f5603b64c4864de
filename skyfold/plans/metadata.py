"""Storage, settings, units and cameras: what the engine writes, reads back, refuses and derives from metadata."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..conf import EngineConf
from ..functions.derived import BUILTIN
from ..functions.geometry import box_distance, box_meets_sphere, in_box
from ..functions.vectors import square
from ..operators import neighbors
from ..operators.camera import Camera, Script
from ..operators.histogram import color_label, histogram1d, histogram2d
from ..operators.neighbors import _kept
from ..orientation import Orientation
from ..shared import shared_folder
from ..snapshot import Snapshot
from ..sources import files
from ..sources.store import ImageWriter, Reader, TimeSeriesWriter, Writer, save_catalog, save_histogram, save_snapshot
from ..timeseries import TimeSeries
from ..timing import timed
from ..unit_rules import builtin_unit
from ..units import Quantity, Unit, raw, split_units, stacked
from . import fixture as x
from . import regions
from .fixture import CLOUD, G, K, SERIES, lit

QUERIES: dict[str, x.Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: x.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _values(names: str, rows: list[tuple]) -> str:
    """SQL for rows given as SQL text."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) t({names})"


def _refused(call: Callable) -> bool:
    try:
        call()
    except (ValueError, KeyError, OSError):
        return True
    return False


def _outcomes(spark, rows: list[tuple[str, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, "step string, refused boolean")


def _stored(spark, write: Callable[[str, str], None], read: Callable[[str, str], DataFrame]) -> DataFrame:
    """What ``read`` gives from a folder of its own in the shared one, which is removed once it is read."""
    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    write(folder, "data")
    out = _kept(read(folder, "data"))
    files.delete(spark, folder)
    return out


# -- snapshots and catalogues


def _snapshot_scan(spark, sf_dir):
    snap = x.by_type(spark, sf_dir)

    def read(folder, base):
        back = Reader(spark, folder, 3, base)
        found = back.snapshot()
        for t in found.types:
            back.expect_rows(f"PartType{t}")
        listed = F.element_at(F.array(*[F.lit(n) for n in back.header["NumPart_Total"]]), F.col("parttype") + 1).cast("long")
        return found._together(None, "Masses").groupBy("parttype").agg(F.count(F.lit(1)).alias("n"), F.max("Masses").alias("top")).withColumn("listed", listed)

    return _stored(spark, lambda folder, base: save_snapshot(spark, snap, folder, base, 3), read)


_TYPE = "CAST(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS INTEGER)"
add("S2_snapshot_scan", _snapshot_scan, f"WITH {G} SELECT {_TYPE} AS parttype, count(*) AS n, max(m) AS top, count(*) AS listed FROM g GROUP BY l_returnflag")


def _catalog_of(spark, sf_dir) -> Catalog:
    orders = x.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return Catalog(orders, x.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), x.HEADER, x.PARAMETERS)


def _load_all(spark, sf_dir):
    return _stored(spark, lambda folder, base: save_catalog(spark, _catalog_of(spark, sf_dir), folder, base, 7), lambda folder, base: Reader(spark, folder, 7, base).load("Group"))


add("S8_load_everything", _load_all, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")


def _reduced_catalog(spark, sf_dir):
    def read(folder, base):
        back = Reader(spark, folder, 7, base)
        found = back.catalog()
        return found.subhalos.select("c_custkey", "c_acctbal", F.lit(back.header["Ngroups_Total"]).cast("long").alias("n_groups"), F.lit(back.header["Nsubhalos_Total"]).cast("long").alias("n_subhalos"))

    return _stored(spark, lambda folder, base: save_catalog(spark, _catalog_of(spark, sf_dir), folder, base, 7, single_precision=True), read)


add("S19_reduced_catalog", _reduced_catalog, "SELECT c_custkey, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS c_acctbal, (SELECT count(*) FROM orders) AS n_groups, count(*) OVER () AS n_subhalos FROM customer")


def _listing(spark, sf_dir):
    info = x.by_type(spark, sf_dir).info(0)
    return spark.createDataFrame([(kind, name) for kind, names in info.items() for name in names], "kind string, name string")


_LISTED = [("with_unit", n) for n in ("Coordinates", "Masses", "Velocities")] + [("without_unit", n) for n in x.KEYS] + [("derived", f"0_{n}") for n in ("MeanMolecularWeight", "VelocityMagnitude")]
add("S9_listing", _listing, _values("kind, name", [(f"'{k}'", f"'{n}'") for k, n in _LISTED]))


def _grouped(spark, sf_dir):
    """A table in a group, comoving lengths to physical ones while it is loaded."""
    part = x.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")

    def write(folder, base):
        w = Writer(spark, folder, base, 2, header=x.HEADER, parameters=x.PARAMETERS)
        w.write_data("Parts", part, {"p_retailprice": "code_length small_a / small_h"}, group="Shop")
        w.finalize()

    return _stored(spark, write, lambda folder, base: Reader(spark, folder, 2, base, to_physical=True).load("Parts", group="Shop"))


add("S12_group_load", _grouped, f"SELECT p_partkey, p_retailprice * {lit(0.5**1.0 * 0.7**-1.0)} AS p_retailprice FROM part")

# -- images, histograms, series

FRAME = Camera((25.0, 25.0, 25.0), (40.0, 20.0, 44.0), "z", 32)


def _pictures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = x.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 32).cast("int").alias("iy"), (F.col("p_partkey") % 32).cast("int").alias("ix"), "p_size", "p_retailprice")
    low = F.col("p_size").cast("double")
    return rows.select("iy", "ix", (low * F.col("p_retailprice")).alias("value")), rows.select("iy", "ix", low.alias("value"))


def _save_pictures(spark, sf_dir, folder, base, mode="w", camera=FRAME, names=("0_PriceTimesSize", "0_Size")):
    w = ImageWriter(spark, camera, folder, base, 4, mode, header=x.HEADER)
    for name, image in zip(names, _pictures(spark, sf_dir)):
        w.save_image(name, image, "code_length")
    w.finalize()


def _image_read(spark, sf_dir):
    def read(folder, base):
        back = Reader(spark, folder, 4, base)
        camera = back.camera()
        return back.derived_image("0_PriceTimesSize").select("iy", "ix", "value", F.lit(camera.area_per_pixel).alias("pixel"), F.lit(camera.npix_height).alias("height"), F.lit(camera.extent[3]).alias("top"))

    return _stored(spark, lambda folder, base: _save_pictures(spark, sf_dir, folder, base), read)


add("S13_image_reader", _image_read, "SELECT CAST(floor(p_partkey / 32) AS INTEGER) AS iy, CAST(p_partkey % 32 AS INTEGER) AS ix, CAST(p_size AS DOUBLE) * p_retailprice / CAST(p_size AS DOUBLE) AS value, 40e0 * 20e0 / (32 * 16) AS pixel, 16 AS height, 25e0 + 20e0 / 2 AS top FROM part")


def _image_writer(spark, sf_dir):
    """Images may be added under the same camera and a new name."""
    outcome: list[tuple[str, bool]] = []

    def write(folder, base):
        def more(camera, names):
            return _refused(lambda: _save_pictures(spark, sf_dir, folder, base, "a", camera, names))

        outcome.append(("first", more(FRAME, ("A", "B"))))
        outcome.append(("another name", more(FRAME, ("C", "D"))))
        outcome.append(("the same name", more(FRAME, ("A", "B"))))
        outcome.append(("another camera", more(FRAME.zoom(2.0), ("E", "F"))))

    return _stored(spark, write, lambda folder, base: _outcomes(spark, outcome))


add("S17_image_writer", _image_writer, _values("step, refused", [("'first'", "FALSE"), ("'another name'", "FALSE"), ("'the same name'", "TRUE"), ("'another camera'", "TRUE")]))


def _writer_modes(spark, sf_dir):
    """Rows of a table after each step: written, refused under the same name, overwritten, refused at another time."""
    part, supplier = (x.table(spark, sf_dir, t).select(F.col(k).alias("key")) for t, k in (("part", "p_partkey"), ("supplier", "s_suppkey")))
    outcome: list[tuple[str, bool, int]] = []

    def write(folder, base):
        def step(name, mode, df, time):
            def go():
                w = Writer(spark, folder, base, 5, mode, header={"Time": time})
                w.write_data("T", df)
                w.finalize()

            refused = _refused(go)
            outcome.append((name, refused, Reader(spark, folder, 5, base).load("T").count()))

        step("w", "w", part, 0.5)
        step("a", "a", supplier, 0.5)
        step("r+", "r+", supplier, 0.5)
        step("other time", "r+", part, 0.25)
        step("w again", "w", part, 0.25)

    return _stored(spark, write, lambda folder, base: spark.createDataFrame(outcome, "step string, refused boolean, n long"))


_P, _S = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM supplier)"
add("S15_writer_modes", _writer_modes, _values("step, refused, n", [("'w'", "FALSE", _P), ("'a'", "TRUE", _P), ("'r+'", "FALSE", _S), ("'other time'", "TRUE", _S), ("'w again'", "FALSE", _P)]))


def _histogram_read(spark, sf_dir):
    def write(folder, base):
        hist = histogram1d(x.particles(spark, sf_dir), F.col("EnergyDissipation"), regions.LOG, {"mass": F.col("Masses")}, log=True, exact=4)
        save_histogram(spark, hist.select("bin", "mass"), folder, base, 6, logscale=True, label="m", edges={"x": regions.LOG})

    def read(folder, base):
        back = Reader(spark, folder, 6, base).histogram()
        middle = F.element_at(F.array(*[F.lit(float(c)) for c in back.centers("x")]), F.col("bin") + 1)
        return back.hist.select("bin", "mass", middle.alias("center"), F.lit(back.logscale).alias("logscale"), F.lit(back.colorlabel).alias("label"))

    return _stored(spark, write, read)


add("S14_histogram_reader", _histogram_read, f"SELECT bin, mass, center, TRUE AS logscale, 'm' AS label FROM ({regions.ORACLES['A7_histogram_log']})")


def _histogram_sink(spark, sf_dir):
    def write(folder, base):
        hist = histogram2d(x.particles(spark, sf_dir), F.col("EnergyDissipation"), F.col("Masses"), (901.0, 105000.0), (0.5, 50.5), 30, 20, F.col("Density"), exact=4)
        save_histogram(spark, hist, folder, base, 6)

    return _stored(spark, write, lambda folder, base: Reader(spark, folder, 6, base).load("hist"))


add("S20_histogram_sink", _histogram_sink, regions.ORACLES["A9_histogram2d"])


def _series_writer(spark, sf_dir):
    def write(folder, base):
        w = TimeSeriesWriter(spark, folder, base)
        w.save_series("values", TimeSeries.of(x.series(spark, sf_dir), "code_length small_a", 0.7))
        w.finalize()

    def read(folder, base):
        back = Reader(spark, folder, None, base).series("values")
        return back.df.select("event_id", "a", "value", F.lit(back.h).alias("h"), F.lit(str(back.unit)).alias("unit"))

    return _stored(spark, write, read)


add("S16_series_writer", _series_writer, f"WITH {SERIES} SELECT event_id, a, value, 0.7e0 AS h, 'code_length small_a' AS unit FROM s")


def _series_times(spark, sf_dir):
    outcome: list[tuple[str, bool]] = []
    s = TimeSeries.of(x.series(spark, sf_dir).groupBy("a").agg(F.max("value").alias("value")), "code_length")

    def write(folder, base):
        w = TimeSeriesWriter(spark, folder, base)
        outcome.append(("first", _refused(lambda: w.save_series("first", s))))
        outcome.append(("same times", _refused(lambda: w.save_series("second", TimeSeries(s.df.withColumn("value", F.col("value") * 2.0), s.unit)))))
        outcome.append(("fewer times", _refused(lambda: w.save_series("third", s.between(0.0, 0.5)))))
        outcome.append(("other times", _refused(lambda: w.save_series("fourth", TimeSeries(s.df.withColumn("a", F.col("a") * (1 + 1e-12)), s.unit)))))
        w.finalize()

    return _stored(spark, write, lambda folder, base: _outcomes(spark, outcome))


add("S21_series_times", _series_times, _values("step, refused", [("'first'", "FALSE"), ("'same times'", "FALSE"), ("'fewer times'", "TRUE"), ("'other times'", "TRUE")]))
_PATHS = {"/data/run/snap_247.hdf5": ("/data/run", "snap", 247), "a/b_c_003": ("a", "b_c", 3), "plain.parquet": ("", "plain", None), "x/y_12": ("x", "y_12", None), "z_1234": ("", "z_1234", None), "/r/s_000/": ("/r", "s", 0)}
add(
    "S22_split_names",
    lambda spark, sf_dir: spark.createDataFrame([(p, *files.split_name(p)) for p in _PATHS], "path string, folder string, base string, number int"),
    "SELECT path, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS folder, regexp_replace(last, '_[0-9]{3}$', '') AS base, CAST(nullif(regexp_extract(last, '_([0-9]{3})$', 1), '') AS INTEGER) AS number "
    "FROM (SELECT path, p, regexp_replace(regexp_extract(p, '[^/]*$'), '\\.(hdf5|parquet)$', '') AS last FROM (SELECT path, rtrim(path, '/') AS p FROM (VALUES " + ", ".join(f"('{p}')" for p in _PATHS) + ") v(path)))",
)

# -- derived columns


add("D20_vector_magnitude", lambda spark, sf_dir: x.particles(spark, sf_dir).select(*x.KEYS, F.sqrt(square(F.col("MagneticField"))).alias("value")), f"WITH {G} SELECT {K}, sqrt(bx * bx + by_ * by_ + bz * bz) AS value FROM g")
_DEFAULTS = "Volume Diameters VelocityMagnitude VelocityCurvature Enstrophy EnstrophyTimesMasses MagneticFieldSquared MagneticFieldStrength MagneticFieldSquaredTimesVolume MagneticCurvature Current Pressure PressureTimesVolume MeanMolecularWeight Temperatures TemperaturesTimesMasses NumberDensity GFM_MetallicityTimesMasses MachnumberTimesEnergyDissipation".split()
add("D21_registry", lambda spark, sf_dir: spark.createDataFrame([(k,) for k in sorted(set(BUILTIN) & set(x.gas(spark, sf_dir).functions()))], "key string"), _values("key", [(f"'0_{n}'",) for n in _DEFAULTS]))


def _own_first(spark, sf_dir):
    """A stored column counts before a derivation of the same name, also as another column's need."""
    snap = x.gas(spark, sf_dir)
    snap = snap._with({0: snap.types[0].withColumn("Temperatures", F.col("Masses") + 1.0)})
    return snap.frame(0, "0_TemperaturesTimesMasses", extra=x.KEYS).withColumnRenamed("TemperaturesTimesMasses", "value")


add("D22_lazy_lookup", _own_first, f"WITH {G} SELECT {K}, (m + 1e0) * m AS value FROM g")


def _forgotten(spark, sf_dir):
    snap = x.gas(spark, sf_dir)
    snap = snap._with({0: snap.types[0].withColumn("Volume", F.lit(7.0))})
    stored = snap.col("0_Volume")
    snap.remove("0_Volume")
    return snap.types[0].select(*x.KEYS, stored.alias("stored"), snap.col("0_Volume").alias("derived"))


add("D23_drop_column", _forgotten, f"WITH {G} SELECT {K}, 7e0 AS stored, m / rho AS derived FROM g")


def _resolved(spark, sf_dir):
    """Needs of needs are met at any depth; what lacks one, or needs itself, is not offered."""
    conf = EngineConf()
    chain = [f"0_Step{k}" for k in range(12)]
    for above, below in zip(chain, [*chain[1:], "0_Masses"]):
        conf.add_user_function(above, lambda s, b=below: s[b] + 1.0, (below,))
    conf.add_user_function("0_Lacking", lambda s: s["0_Nothing"], ("0_Nothing",))
    conf.add_user_function("0_Ring1", lambda s: s["0_Ring2"], ("0_Ring2",))
    conf.add_user_function("0_Ring2", lambda s: s["0_Ring1"], ("0_Ring1",))
    snap = x.gas(spark, sf_dir, conf)
    known = snap.functions()
    offered = [F.lit(k in known).alias(n) for k, n in (("0_Lacking", "lacking"), ("0_Ring1", "ring"))]
    return snap.types[0].select(*x.KEYS, snap["0_Step0"].alias("value"), *offered)


add("D24_dependencies", _resolved, f"WITH {G} SELECT {K}, m {'+ 1e0 ' * 12}AS value, FALSE AS lacking, FALSE AS ring FROM g")


def _aliased(spark, sf_dir):
    conf = EngineConf()
    conf.set_aliases({"0_Masses": "M", "0_Density": "rho"})
    return x.gas(spark, sf_dir, conf).frame(0, "M", "rho", "0_Volume", extra=x.KEYS)


add("D26_aliases", _aliased, f'WITH {G} SELECT {K}, m AS "M", rho, m / rho AS "Volume" FROM g')
_LABELS = [(("x", "y", None, True, True), r"$N_\mathrm{tot}^{-1}\,\mathrm{d}^2 N / \mathrm{d}\log_{10}(x)\,\mathrm{d}\log_{10}(y)$"), (("T", "p", "M", False, False), r"$\mathrm{d}^2 M / \mathrm{d}T\,\mathrm{d}p$"), (("T", "p", "M", True, False), r"$M_\mathrm{tot}^{-1}\,\mathrm{d}^2 M / \mathrm{d}T\,\mathrm{d}p$")]
add("A10_color_label", lambda spark, sf_dir: spark.createDataFrame([(i, color_label(*args)) for i, (args, _) in enumerate(_LABELS)], "i int, label string"), _values("i, label", [(str(i), f"'{text}'") for i, (_, text) in enumerate(_LABELS)]))

# -- places

LOW, HIGH, BALL = (-0.2, -0.1, -0.3), (0.2, 0.3, 0.1), 0.15


def _boxes(spark, sf_dir):
    pos = F.col("pos")
    return x.cloud(spark, sf_dir).select("id", in_box(pos, LOW, HIGH).alias("inside"), box_distance(pos, LOW, HIGH).alias("distance"), box_meets_sphere(LOW, HIGH, pos, BALL).alias("meets"))


_GAPS = [f"greatest(0e0, {lit(a)} - {c}, {c} - {lit(b)})" for c, a, b in zip("xyz", LOW, HIGH)]
_GAP2 = " + ".join(f"{g} * {g}" for g in _GAPS)
add("T9_boxes", _boxes, f"WITH {CLOUD} SELECT id, {' AND '.join(f'{c} >= {lit(a)} AND {c} <= {lit(b)}' for c, a, b in zip('xyz', LOW, HIGH))} AS inside, sqrt({_GAP2}) AS distance, {_GAP2} <= {lit(BALL * BALL)} AS meets FROM p")


def _sorted_by_key(spark, sf_dir):
    """Partitions hold ranges of the key, and each is sorted by it: so many places where it falls."""
    df = _kept(neighbors.clustered(x.cloud(spark, sf_dir), "pos", 4).select("morton", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    before = F.lag("morton").over(Window.partitionBy("part").orderBy("at"))
    total = df.withColumn("before", before).agg(F.coalesce(F.sum((F.col("morton") < F.col("before")).cast("long")), F.lit(0)).alias("falls"), F.count(F.lit(1)).alias("n"))
    # one row for each partition: the end of the one before is no later than its start
    ends = df.groupBy("part").agg(F.min("morton").alias("lo"), F.max("morton").alias("hi"))
    crossed = ends.withColumn("last", F.max("hi").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).agg(F.coalesce(F.sum((F.col("last") > F.col("lo")).cast("long")), F.lit(0)).alias("crossed"))
    return total.crossJoin(crossed)


add("T4_sorted_by_key", _sorted_by_key, "SELECT CAST(0 AS BIGINT) AS falls, CAST(0 AS BIGINT) AS crossed, CAST(count(*) AS BIGINT) AS n FROM embeddings")
_HALF = "(0.05e0 + 0.01e0 * (id % 7))"
_GRID = "q AS (SELECT i AS id, -0.55e0 + (i % 12) * 0.1e0 AS x, -0.55e0 + ((i // 12) % 12) * 0.1e0 AS y, -0.55e0 + (i // 144) * 0.1e0 AS z FROM range(1728) t(i))"
_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _holding(spark, sf_dir):
    from .images import _lattice

    return neighbors.nearest_holding(x.cloud(spark, sf_dir), _lattice(spark), F.lit(0.05) + F.lit(0.01) * (F.col("id") % 7))


_WITHIN = " AND ".join(f"a.{c} >= b.{c} - b.h AND a.{c} <= b.{c} + b.h" for c in "xyz")
add("J5_nearest_holding", _holding, f"WITH {CLOUD}, {_GRID}, b AS (SELECT *, {_HALF} AS h FROM p), f AS (SELECT a.id AS qid, b.id AS id, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS r FROM q a JOIN b ON {_WITHIN}) SELECT q.id AS qid, f.id, d2 FROM q LEFT JOIN f ON f.qid = q.id AND r = 1")

# -- cameras


def _geometry(spark, sf_dir):
    def of(name: str, c: Camera) -> tuple:
        return name, c.width, c.height, c.depth, c.npix_width, c.npix_height, c.area_per_pixel, c.volume, *c.extent

    side = Camera((1.0, 2.0, 3.0), (8.0, 4.0, 2.0), "x", 64)
    turned = Camera((1.0, 2.0, 3.0), (8.0, 4.0, 2.0), Orientation(normal=(1, 1, 1)), 64)
    return spark.createDataFrame([of("plain", FRAME), of("side", side), of("turned", turned)], "name string, width double, height double, depth double, nx int, ny int, pixel double, volume double, x0 double, x1 double, y0 double, y1 double")


add(
    "P1_geometry",
    _geometry,
    _values(
        "name, width, height, depth, nx, ny, pixel, volume, x0, x1, y0, y1",
        [
            ("'plain'", "40e0", "20e0", "44e0", "32", "16", "40e0 * 20e0 / (32 * 16)", "40e0 * 20e0 * 44e0", "25e0 - 20e0", "25e0 + 20e0", "25e0 - 10e0", "25e0 + 10e0"),
            ("'side'", "4e0", "2e0", "8e0", "64", "32", "4e0 * 2e0 / (64 * 32)", "8e0 * 4e0 * 2e0", "2e0 - 2e0", "2e0 + 2e0", "3e0 - 1e0", "3e0 + 1e0"),
            ("'turned'", "8e0", "4e0", "2e0", "64", "32", "8e0 * 4e0 / (64 * 32)", "8e0 * 4e0 * 2e0", "-4e0", "4e0", "-2e0", "2e0"),
        ],
    ),
)


def _camera_rows(spark, cameras: list[tuple[str, Camera]]) -> DataFrame:
    return spark.createDataFrame([(n, *c.center, *c.widths, c.npix) for n, c in cameras], "step string, x double, y double, z double, wx double, wy double, wz double, npix int")


def _moves(spark, sf_dir):
    c = Camera((1.0, 2.0, 3.0), (8.0, 4.0, 2.0), "y", 64)
    steps = [("start", c)]
    for name, move in (("zoom", lambda c: c.zoom(2.0)), ("move", lambda c: c.move(width=1.0, height=0.5, depth=-2.0)), ("resize", lambda c: c.resized(depth=5.0)), ("recenter", lambda c: c.recentered((0.0, 0.0, 1.0))), ("double", lambda c: c.double_resolution()), ("half", lambda c: c.half_resolution().half_resolution())):
        steps.append((name, move(steps[-1][1])))
    return _camera_rows(spark, steps)


#: In direction y, width, height and depth run along z, x and y.
_STEPS = [("start", (1, 2, 3, 8, 4, 2, 64)), ("zoom", (1, 2, 3, 4, 2, 1, 64)), ("move", (1.5, 0, 4, 4, 2, 1, 64)), ("resize", (1.5, 0, 4, 4, 5, 1, 64)), ("recenter", (0, 0, 1, 4, 5, 1, 64)), ("double", (0, 0, 1, 4, 5, 1, 128)), ("half", (0, 0, 1, 4, 5, 1, 32))]
add("P12_camera_moves", _moves, _values("step, x, y, z, wx, wy, wz, npix", [(f"'{n}'", *[f"{float(v)}e0" for v in r[:6]], str(r[6])) for n, r in _STEPS]))


def _script(spark, sf_dir):
    start = Camera((0.0, 0.0, 0.0), (16.0, 16.0, 16.0), Orientation(normal=(0, 0, 1), perp1=(1, 0, 0)), 32)
    script = Script(start).do("zoom", 8.0).waypoint("near").do("rotated", "x", 90.0).do("move", 0.0, 0.0, 1.0).subdivided(2.0, 30.0)
    cameras = [("all", i, c) for i, c in enumerate(script.cameras())] + [("near", i, c) for i, c in enumerate(script.cameras("near"))]
    rows = [(part, i, round(c.widths[0], 9), *[round(float(v), 9) + 0.0 for v in c.direction.normal], *[round(float(v), 9) + 0.0 for v in c.center]) for part, i, c in cameras]
    return spark.createDataFrame(rows, "part string, i int, width double, nx double, ny double, nz double, x double, y double, z double")


def _script_rows() -> list[tuple]:
    """Three halvings, three turns of thirty degrees, then a step along the turned normal."""
    path = [(16.0, 0, 0.0), (8.0, 0, 0.0), (4.0, 0, 0.0), (2.0, 0, 0.0), (2.0, 30, 0.0), (2.0, 60, 0.0), (2.0, 90, 0.0), (2.0, 90, 1.0)]
    out = []
    for part, rows in (("all", path), ("near", path[3:])):
        for i, (w, turn, step) in enumerate(rows):
            normal = (0.0, -math.sin(math.radians(turn)), math.cos(math.radians(turn)))
            out.append((part, i, w, *[round(v, 9) + 0.0 for v in normal], *[round(v * step, 9) + 0.0 for v in normal]))
    return out


add("P14_script", _script, _values("part, i, width, nx, ny, nz, x, y, z", [(f"'{r[0]}'", str(r[1]), *[lit(v) for v in r[2:]]) for r in _script_rows()]))


def _orientations(spark, sf_dir):
    start = Orientation(normal=(0, 0, 1), perp1=(1, 0, 0))
    turned = {"start": start, "x": start.rotate_around_x(degrees=90), "y": start.rotate_around_y(degrees=90), "z": start.rotate_around_z(radians=math.pi / 2), "perp2": start.rotate_around_z(degrees=90).rotate_around_perp2(degrees=90), "copy": start.copy()}
    rows = [(name, axis, *[round(float(v), 12) + 0.0 for v in getattr(o, axis)]) for name, o in turned.items() for axis in ("perp1", "perp2", "normal")]
    return spark.createDataFrame(rows, "name string, axis string, x double, y double, z double")


_AXES = {"start": ((1, 0, 0), (0, 1, 0), (0, 0, 1)), "x": ((1, 0, 0), (0, 0, 1), (0, -1, 0)), "y": ((0, 0, -1), (0, 1, 0), (1, 0, 0)), "z": ((0, 1, 0), (-1, 0, 0), (0, 0, 1)), "perp2": ((0, 0, -1), (-1, 0, 0), (0, 1, 0)), "copy": ((1, 0, 0), (0, 1, 0), (0, 0, 1))}
add("P16_orientations", _orientations, _values("name, axis, x, y, z", [(f"'{n}'", f"'{a}'", *[f"{float(c)}e0" for c in v]) for n, m in _AXES.items() for a, v in zip(("perp1", "perp2", "normal"), m)]))

# -- units and settings

_TEXTS = [("M", "code_mass / small_h", r"$M\; \left[1.989e+43 g h^{-1}\right]$"), ("v", "km / s", r"$v\; \left[km / s\right]$"), ("f", "", "$f$")]
add("U8_labels", lambda spark, sf_dir: spark.createDataFrame([(s, Quantity(1.0, u).label(s)) for s, u, _ in _TEXTS], "symbol string, label string"), _values("symbol, label", [(f"'{s}'", f"'{t}'") for s, _, t in _TEXTS]))


def _times(spark, sf_dir):
    snap = x.gas(spark, sf_dir)
    return spark.createDataFrame([(snap.a, snap.h, snap.z, Quantity(1.0, "cm", 0.25).z)], "a double, h double, z double, other double")


add("U9_times", _times, "SELECT 0.5e0 AS a, 0.7e0 AS h, 1 / 0.5e0 - 1 AS z, 1 / 0.25e0 - 1 AS other")


def _ages(spark, sf_dir):
    """Ages in Gyr, look-back times and critical densities (in units of 1e-30 g/cm^3) at some redshifts."""
    snap = x.gas(spark, sf_dir)
    rows = [(z, round(snap.age(z), 9), round(snap.lookback_time(z), 9), round(snap.rho_crit(z) * 1e30, 9)) for z in (0.0, 0.5, 1.0, 3.0, 10.0)]
    return spark.createDataFrame(rows, "z double, age double, back double, density double")


_TH = 3.0856775814913674e19 / 70 / (31557600.0 * 1e9)
_S = "(sqrt(0.7e0 / 0.3e0) * pow(1 + z, -1.5e0))"
_S0 = "sqrt(0.7e0 / 0.3e0)"
_AGE = f"{lit(_TH)} * 2 / (3 * sqrt(0.7e0)) * ln"
add("U10_ages", _ages, f"SELECT z, round({_AGE}({_S} + sqrt(1 + {_S} * {_S})), 9) AS age, round({_AGE}({_S0} + sqrt(1 + {_S0} * {_S0})) - {_AGE}({_S} + sqrt(1 + {_S} * {_S})), 9) AS back, round({lit(3 * (70 / 3.0856775814913674e19) ** 2 / (8 * math.pi * 6.6743e-8) * 1e30)} * (0.3e0 * pow(1 + z, 3e0) + 0.7e0), 9) AS density FROM (VALUES (0e0), (0.5e0), (1e0), (3e0), (10e0)) t(z)")


def _split(spark, sf_dir):
    rows = [(text, part, base, str(power)) for text in ("code_density small_h2 / small_a3", "G small_a^-2 small_h", "km / s small_a^(1/2)") for part, powers in zip(("physical", "cosmic"), split_units(Unit.parse(text))) for base, power in powers.items()]
    return spark.createDataFrame(rows, "unit string, part string, base string, power string")


_SPLIT = {"code_density small_h2 / small_a3": "cm -3 g 1 h 2 a -3", "G small_a^-2 small_h": "cm -1/2 g 1/2 s -1 a -2 h 1", "km / s small_a^(1/2)": "cm 1 s -1 a 1/2"}
add("U11_split_units", _split, _values("unit, part, base, power", [(f"'{u}'", "'cosmic'" if b in "ah" else "'physical'", f"'{b}'", f"'{p}'") for u, t in _SPLIT.items() for b, p in zip(t.split()[0::2], t.split()[1::2])]))


def _lists(spark, sf_dir):
    """Quantities of one unit are one array; others are refused, and so are sums over different a or h."""
    one, two, other = Quantity(1.0, "kpc", 0.5, 0.7), Quantity(2.0, "kpc", 0.5, 0.7), Quantity(3.0, "km", 0.5, 0.7)
    both = stacked([one, two])
    rows = [("array", False, float(both.value.sum())), ("other unit", _refused(lambda: stacked([one, other])), 0.0), ("other time", _refused(lambda: stacked([one, two.set_time(a=0.25)])), 0.0)]
    return spark.createDataFrame(rows, "step string, refused boolean, total double")


add("U12_list_to_array", _lists, _values("step, refused, total", [("'array'", "FALSE", "3e0"), ("'other unit'", "TRUE", "0e0"), ("'other time'", "TRUE", "0e0")]))
_KNOWN = [("voronoi_cells", "Coordinates", "code_length small_a / small_h"), ("dark_matter", "Masses", "code_mass / small_h"), ("stars", "Velocities", "code_velocity small_a^(1/2)"), ("voronoi_cells", "Density", "code_density small_h2 / small_a3"), ("voronoi_cells", "InternalEnergy", "code_velocity^2"), ("groups", "GroupVel", "code_velocity / small_a"), ("subhalos", "SubhaloSpin", "code_length code_velocity / small_h"), ("groups", "Unknown", None)]
add("U15_unit_lookup", lambda spark, sf_dir: spark.createDataFrame([(s, b, None if builtin_unit(s, b) is None else str(builtin_unit(s, b))) for s, b, _ in _KNOWN], "species string, block string, unit string"), _values("species, block, unit", [(f"'{s}'", f"'{b}'", f"'{u}'" if u else "NULL") for s, b, u in _KNOWN]))


def _raw_lengths(spark, sf_dir):
    a, b = Quantity(F.col("Masses"), "kpc"), Quantity(F.col("Density"), "kpc")
    p, q = raw(a, b)
    refused = _refused(lambda: raw(a, Quantity(1.0, "Mpc"))) and _refused(lambda: raw(a, Quantity(1.0, "kpc small_a")))
    mixed = not _refused(lambda: raw(a, Quantity(1.0, "km / s"), 3.0))
    return x.particles(spark, sf_dir).select(*x.KEYS, (p + q).alias("value"), F.lit(refused).alias("refused"), F.lit(mixed).alias("mixed"))


add("U16_raw_lengths", _raw_lengths, f"WITH {G} SELECT {K}, m + rho AS value, TRUE AS refused, TRUE AS mixed FROM g")


def _guard(spark, sf_dir):
    a, b = Quantity(1.0, "kpc", 0.5, 0.7), Quantity(500.0, "pc", 0.5, 0.7)
    rows = [("same", False, (a + b).value), ("other a", _refused(lambda: a + b.set_time(a=0.25)), 0.0), ("other h", _refused(lambda: a - Quantity(1.0, "kpc", 0.5, 0.6)), 0.0), ("other kind", _refused(lambda: a + Quantity(1.0, "km / s", 0.5, 0.7)), 0.0)]
    return spark.createDataFrame(rows, "step string, refused boolean, value double")


add("U17_arithmetic_guard", _guard, _values("step, refused, value", [("'same'", "FALSE", "1.5e0"), ("'other a'", "TRUE", "0e0"), ("'other h'", "TRUE", "0e0"), ("'other kind'", "TRUE", "0e0")]))


def _timed(spark, sf_dir):
    count = timed(lambda t: x.table(spark, sf_dir, t).count())
    return spark.createDataFrame([("part", count("part")), ("supplier", count("supplier", timing=True))], "name string, n long")


add("U18_timed", _timed, f"SELECT 'part' AS name, {_P} AS n UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier)")


def _only_own(spark, sf_dir):
    conf = EngineConf(only_user_functions=True)
    conf.add_user_function("0_Own", lambda s: s["0_Masses"] * 3.0, ("0_Masses",))
    snap = x.gas(spark, sf_dir, conf)
    return snap.types[0].select(*x.KEYS, snap["0_Own"].alias("own"), F.lit(",".join(sorted(snap.functions()))).alias("offered"), F.lit(_refused(lambda: snap["0_Volume"])).alias("refused"))


add("X2_only_user_functions", _only_own, f"WITH {G} SELECT {K}, m * 3e0 AS own, '0_Own' AS offered, TRUE AS refused FROM g")


def _user_units(spark, sf_dir):
    conf = EngineConf()
    conf.add_user_unit("voronoi_cells", "Machnumber2", "km / s")
    rows = [("new", False, str(Snapshot({0: spark.range(1)}, x.HEADER, x.PARAMETERS, {}, conf).unit("0_Machnumber2"))), ("as built in", _refused(lambda: conf.add_user_unit("voronoi_cells", "Masses", "code_mass / small_h")), ""), ("against it", _refused(lambda: conf.add_user_unit("voronoi_cells", "Masses", "kg")), "")]
    return spark.createDataFrame(rows, "step string, refused boolean, unit string")


add("X3_user_units", _user_units, _values("step, refused, unit", [("'new'", "FALSE", "'km / s'"), ("'as built in'", "FALSE", "''"), ("'against it'", "TRUE", "''")]))


def _own_reader(spark, sf_dir):
    """A reader of another layout: orders as dark matter, by overriding what a snapshot is made of."""

    class Shop(Reader):
        def __init__(self, folder: str):
            self.spark, self.path, self.conf, self.physical = spark, folder, EngineConf(), False
            self.meta = {"header": x.HEADER, "parameters": x.PARAMETERS}

        def snapshot(self) -> Snapshot:
            orders = self.load("orders").select("o_orderkey", F.col("o_totalprice").alias("Masses"))
            return Snapshot({1: orders}, self.header, self.parameters, {}, self.conf)

    return Shop(sf_dir).snapshot().frame(1, "1_Masses", extra=["o_orderkey"], to_physical=True).withColumnRenamed("Masses", "value")


add("X4_custom_reader", _own_reader, f"SELECT o_orderkey, o_totalprice * {lit(0.7**-1.0 * 0.5**0.0)} AS value FROM orders")


def _settings(spark, sf_dir):
    path = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}.json"
    files.write_json(spark, path, {"strict_units": True, "aliases": {"0_Masses": "weight"}, "user_units": {"voronoi_cells/Speed": "km / s"}})
    conf = EngineConf.load(path, spark)
    files.delete(spark, path)
    strict = _refused(lambda: x.gas(spark, sf_dir, conf).unit("0_Nameless"))
    return x.gas(spark, sf_dir, conf).frame(0, "weight", extra=x.KEYS).withColumn("strict", F.lit(strict)).withColumn("unit", F.lit(str(conf.user_units["voronoi_cells", "Speed"])))


add("X5_settings_file", _settings, f"WITH {G} SELECT {K}, m AS weight, TRUE AS strict, 'km / s' AS unit FROM g")


def _user_aggregate(spark, sf_dir):
    conf = EngineConf()

    def spread(c: Column) -> Column:
        return F.max(c) - F.min(c)

    conf.add_user_aggregate("spread", spread)
    return x.gas(spark, sf_dir, conf).aggregate("spread", "0_Volume", ["l_linenumber"])


add("X6_user_aggregate", _user_aggregate, f"WITH {G} SELECT l_linenumber, max(m / rho) - min(m / rho) AS spread FROM g GROUP BY l_linenumber")
