"""Geometric predicates, selections, sums and histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.bins import make_edges
from ..functions.geometry import box, rotated_box, shell
from ..functions.vectors import parts
from ..operators import aggregates as agg
from ..operators.histogram import histogram1d, histogram2d, profile, with_shell_volume
from . import fixture as x
from .fixture import G, dsum, lit

QUERIES: dict[str, x.Query] = {}
ORACLES: dict[str, str] = {}
WIDTHS = (20.0, 24.0, 30.0)
CX, CY, CZ = x.CENTER


def add(name: str, query: x.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _pos():
    return F.col("Coordinates")


def _margin():
    return F.col("ElectronAbundance") * F.lit(40.0)


def _survivors(df):
    px, _, _ = parts(_pos())
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), agg.total(F.col("Masses"), 4).alias("mass"), agg.total(px, 4).alias("sx"))


def _region(name: str, predicate, sql: str) -> None:
    add(name, lambda spark, sf_dir: _survivors(x.particles(spark, sf_dir).filter(predicate())), f"WITH {G} SELECT l_returnflag, count(*) AS n, {dsum('m')} AS mass, {dsum('x')} AS sx FROM g WHERE {sql} GROUP BY l_returnflag")


def _box_sql(margin: str = "") -> str:
    return " AND ".join(f"abs({c} - {m}) < {w / 2}{margin}" for c, m, w in zip("xyz", ("25e0",) * 3, WIDTHS))


def _rot_sql(margin: str = "") -> str:
    d = [f"({c} - 25e0)" for c in "xyz"]
    return " AND ".join(f"abs({d[0]} * {lit(r[0])} + {d[1]} * {lit(r[1])} + {d[2]} * {lit(r[2])}) < {w / 2}{margin}" for r, w in zip(x.TILTED.inverse, WIDTHS))


R2 = "((x - 25e0) * (x - 25e0) + (y - 25e0) * (y - 25e0) + (z - 25e0) * (z - 25e0))"
T = "(ne * 40e0)"
_region("F1_box", lambda: box(_pos(), x.CENTER, WIDTHS), _box_sql())
_region("F2_box_margin", lambda: box(_pos(), x.CENTER, WIDTHS, _margin(), 4.0), _box_sql(f" + {T}"))
_region("F3_rotated_box", lambda: rotated_box(_pos(), x.CENTER, WIDTHS, x.TILTED), _rot_sql())
_region("F4_rotated_box_margin", lambda: rotated_box(_pos(), x.CENTER, WIDTHS, x.TILTED, _margin(), 4.0), _rot_sql(f" + {T}"))
_region("F5_shell", lambda: shell(_pos(), x.CENTER, 20.0, 8.0), f"{R2} < 400e0 AND {R2} >= 64e0")
_region("F6_shell_margin", lambda: shell(_pos(), x.CENTER, 16.0, 2.0, _margin(), 4.0), f"{R2} < (16e0 + {T}) * (16e0 + {T}) AND {R2} >= CASE WHEN 2e0 > {T} THEN (2e0 - {T}) * (2e0 - {T}) ELSE 0e0 END")


def _chain(spark, sf_dir):
    snap = x.gas(spark, sf_dir).select(0, F.col("Density") > 4).select(0, box(_pos(), x.CENTER, WIDTHS))
    return _survivors(snap.types[0])


add("F7_select_chain", _chain, f"WITH {G} SELECT l_returnflag, count(*) AS n, {dsum('m')} AS mass, {dsum('x')} AS sx FROM g WHERE rho > 4 AND {_box_sql()} GROUP BY l_returnflag")


def _by_ids(spark, sf_dir):
    """An index array: rows whose id is among those of the large orders."""
    snap = x.gas(spark, sf_dir)
    snap.row_id = "l_orderkey"
    big = x.table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return _survivors(snap.select(0, big).types[0])


add("F7_select_by_ids", _by_ids, f"WITH {G} SELECT l_returnflag, count(*) AS n, {dsum('m')} AS mass, {dsum('x')} AS sx FROM g WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) GROUP BY l_returnflag")


def _radial_types(spark, sf_dir):
    snap = x.by_type(spark, sf_dir).radial_select(x.CENTER, 20.0)
    return snap._together(None, "Masses").groupBy("parttype").agg(F.count(F.lit(1)).alias("n"), agg.total(F.col("Masses"), 4).alias("mass"))


TYPE = "CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"
add("F8_radial_select_types", _radial_types, f"WITH {G} SELECT CAST({TYPE} AS INTEGER) AS parttype, count(*) AS n, {dsum('m')} AS mass FROM g WHERE {R2} < 400e0 GROUP BY l_returnflag")
add("F9_comparison", lambda spark, sf_dir: _survivors(x.gas(spark, sf_dir).select(0, F.col("InternalEnergy") >= 50).types[0]), f"WITH {G} SELECT l_returnflag, count(*) AS n, {dsum('m')} AS mass, {dsum('x')} AS sx FROM g WHERE u >= 50 GROUP BY l_returnflag")

add("A1_sum", lambda spark, sf_dir: x.gas(spark, sf_dir).sum_of("0_Masses", exact=4), f"WITH {G} SELECT {dsum('m')} AS total FROM g")
add("A2_vector_sum", lambda spark, sf_dir: x.gas(spark, sf_dir).sum_of("0_Coordinates", exact=4), f"WITH {G} SELECT {', '.join(f'{dsum(c)} AS {c}' for c in 'xyz')} FROM g")


def _weighted(spark, sf_dir):
    return agg.weighted_sum(x.particles(spark, sf_dir), F.col("Masses"), _pos(), exact=4)


add("A3_weighted_sum", _weighted, f"WITH {G} SELECT {', '.join(f'{dsum(f"m * {c}")} AS {c}' for c in 'xyz')} FROM g")
_L = {"x": "m * ((y - 25e0) * vz - (z - 25e0) * vy)", "y": "m * ((z - 25e0) * vx - (x - 25e0) * vz)", "z": "m * ((x - 25e0) * vy - (y - 25e0) * vx)"}
add("A4_cross_sum", lambda spark, sf_dir: agg.angular_momentum(x.particles(spark, sf_dir), F.col("Masses"), _pos(), F.col("Velocities"), x.CENTER, exact=4), f"WITH {G} SELECT {', '.join(f'{dsum(t)} AS {c}' for c, t in _L.items())} FROM g")
_COM = f"{dsum('m')} AS mass, " + ", ".join(f"{dsum(f'm * {c}')} / {dsum('m')} AS {c}" for c in "xyz")
add("A5_center_of_mass", lambda spark, sf_dir: x.by_type(spark, sf_dir).center_of_mass(exact=4), f"WITH {G} SELECT CAST({TYPE} AS INTEGER) AS parttype, {_COM} FROM g GROUP BY l_returnflag UNION ALL SELECT NULL, {_COM} FROM g")
add("A6_angular_momentum", lambda spark, sf_dir: x.by_type(spark, sf_dir).total_angular_momentum(x.CENTER, exact=4), f"WITH {G} SELECT CAST({TYPE} AS INTEGER) AS parttype, {', '.join(f'{dsum(t)} AS {c}' for c, t in _L.items())} FROM g GROUP BY l_returnflag")
def _limits(spark, sf_dir):
    """The ends of two columns, as the bin builder takes them; of the second only positive values count."""
    rows = x.particles(spark, sf_dir)
    (lo, hi), (positive, _) = agg.limits(rows, F.col("EnergyDissipation")), agg.limits(rows, F.col("ElectronAbundance"), positive=True)
    return spark.createDataFrame([(lo, hi, positive)], "lo double, hi double, positive double")


add("A11_limits", _limits, f"WITH {G} SELECT min(diss) AS lo, max(diss) AS hi, min(CASE WHEN ne > 0 THEN ne END) AS positive FROM g")

# -- histograms

LINEAR, LOG = make_edges(901.0, 105000.0, 40), make_edges(901.0, 105000.0, 40, log=True)


def _bins(edges, log: bool) -> str:
    mid = np.sqrt(edges[1:] * edges[:-1]) if log else 0.5 * (edges[1:] + edges[:-1])
    return "bins(bin, lo, hi, center) AS (VALUES " + ", ".join(f"({i}, {lit(a)}, {lit(b)}, {lit(c)})" for i, (a, b, c) in enumerate(zip(edges[:-1], edges[1:], mid))) + ")"


def _hist_sql(edges, log: bool, sums: dict[str, str], value: str = "diss", where: str = "TRUE") -> str:
    each = ", ".join(f"coalesce({dsum(e)}, 0e0) AS {n}" for n, e in sums.items())
    return f"SELECT bin, lo, hi, center, {each} FROM bins LEFT JOIN (SELECT *, {value} AS v FROM g WHERE {where}) ON v >= lo AND v < hi GROUP BY bin, lo, hi, center"


def _hist(edges, log=False, normalize=False, many=False):
    def query(spark, sf_dir):
        weights = {"mass": F.col("Masses")} | ({"energy": F.col("InternalEnergy"), "volume": F.round(F.col("Masses") / F.col("Density"), 6)} if many else {})
        out = histogram1d(x.particles(spark, sf_dir), F.col("EnergyDissipation"), edges, weights, log, normalize, exact=4)
        return out.withColumn("mass", F.round("mass", 12)) if normalize else out

    return query


add("A7_histogram", _hist(LINEAR), f"WITH {G}, {_bins(LINEAR, False)} {_hist_sql(LINEAR, False, {'mass': 'm'})}")
add("A7_histogram_log", _hist(LOG, log=True), f"WITH {G}, {_bins(LOG, True)} {_hist_sql(LOG, True, {'mass': 'm'})}")
add("A7_histogram_many", _hist(LOG, log=True, many=True), f"WITH {G}, {_bins(LOG, True)} {_hist_sql(LOG, True, {'mass': 'm', 'energy': 'u', 'volume': 'round(m / rho, 6)'})}")
add("A7_histogram_normalized", _hist(LINEAR, normalize=True), f"WITH {G}, {_bins(LINEAR, False)}, h AS ({_hist_sql(LINEAR, False, {'mass': 'm'})}) SELECT bin, lo, hi, center, round(mass / (sum(mass) OVER ()) / (hi - lo), 12) AS mass FROM h")


def _auto(spark, sf_dir):
    """A number of bins: limits are the data's, so the largest value falls out."""
    return histogram1d(x.particles(spark, sf_dir), F.col("Masses"), 7, {"n": F.lit(1.0)}, exact=4)


_AUTO = make_edges(1.0, 50.0, 7)
add("A8_automatic_bins", _auto, f"WITH {G}, {_bins(_AUTO, False)} {_hist_sql(_AUTO, False, {'n': 'CASE WHEN v IS NULL THEN NULL ELSE 1 END'}, 'm')}")


def _hist2(log: bool, normalize: bool = False):
    def query(spark, sf_dir):
        out = histogram2d(x.particles(spark, sf_dir), F.col("EnergyDissipation"), F.col("Masses"), (901.0, 105000.0), (0.5, 50.5), 30, 20, F.col("Density"), log, normalize, exact=4)
        return out.withColumn("value", F.round("value", 12)) if normalize else out

    return query


def _index(e: str, lo: float, hi: float, n: int, log: bool) -> str:
    a, b = (float(np.log10(lo)), float(np.log10(hi))) if log else (lo, hi)
    return f"CAST(floor(({f'log10({e})' if log else e} - {lit(a)}) * {n}e0 / {lit(b - a)}) AS INTEGER)"


def _hist2_sql(log: bool) -> str:
    return f"b AS (SELECT {_index('m', 0.5, 50.5, 20, log)} AS iy, {_index('diss', 901.0, 105000.0, 30, log)} AS ix, rho FROM g WHERE m >= 0.5 AND m <= 50.5 AND diss >= 901 AND diss <= 105000), h AS (SELECT iy, ix, {dsum('rho')} AS value FROM b WHERE iy BETWEEN 0 AND 19 AND ix BETWEEN 0 AND 29 GROUP BY iy, ix)"


add("A9_histogram2d", _hist2(False), f"WITH {G}, {_hist2_sql(False)} SELECT * FROM h")
add("A9_histogram2d_log", _hist2(True), f"WITH {G}, {_hist2_sql(True)} SELECT * FROM h")
_AREA = float(np.prod([(b - a) / n for a, b, n in ((901.0, 105000.0, 30), (0.5, 50.5, 20))]))
add("A9_histogram2d_normalized", _hist2(False, True), f"WITH {G}, {_hist2_sql(False)} SELECT iy, ix, round(value / ((SELECT {dsum('value')} FROM h) * {lit(_AREA)}), 12) AS value FROM h")

RADII = make_edges(1.0, 30.0, 20, log=True)


def profile_mean(spark, sf_dir):
    """Mass-weighted mean temperature in radial shells around a centre: sphere, derived column, log bins, weighted mean."""
    snap = x.gas(spark, sf_dir).radial_select(x.CENTER, 30.0)
    px, py, pz = parts(_pos())
    r = F.sqrt((px - CX) * (px - CX) + (py - CY) * (py - CY) + (pz - CZ) * (pz - CZ))
    temperature = snap["0_InternalEnergy"] * snap["0_MeanMolecularWeight"]
    out = profile(snap.types[0], r, RADII, F.col("Masses"), {"temperature": temperature}, log=True, exact=6)
    return out


add("profile_mean", profile_mean, f"WITH {G}, {_bins(RADII, True)}, h AS (SELECT bin, lo, hi, center, coalesce({dsum('m', 6)}, 0e0) AS weight, coalesce({dsum('m * (u * (4e0 / ((1e0 + 3e0 * metal) + 4e0 * metal * ne)))', 6)}, 0e0) AS t FROM bins LEFT JOIN (SELECT *, sqrt{R2} AS r FROM g WHERE {R2} < 900e0) ON r >= lo AND r < hi GROUP BY bin, lo, hi, center) SELECT bin, lo, hi, center, weight, CASE WHEN weight > 0 THEN t / weight END AS temperature FROM h")
QUERIES["A12_profile_mean"], ORACLES["A12_profile_mean"] = QUERIES["profile_mean"], ORACLES["profile_mean"]


def _shell_density(spark, sf_dir):
    px, py, pz = parts(_pos())
    r = F.sqrt((px - CX) * (px - CX) + (py - CY) * (py - CY) + (pz - CZ) * (pz - CZ))
    h = with_shell_volume(histogram1d(x.particles(spark, sf_dir), r, RADII, {"mass": F.col("Masses")}, log=True, exact=4))
    return h.select("bin", "mass", F.round("volume", 6).alias("volume"), F.round(F.col("mass") / F.col("volume"), 9).alias("density"))


_V = f"({lit(4 * np.pi / 3)} * (hi * hi * hi - lo * lo * lo))"
add("A13_shell_density", _shell_density, f"WITH {G}, {_bins(RADII, True)}, h AS ({_hist_sql(RADII, True, {'mass': 'm'}, f'sqrt{R2}')}) SELECT bin, mass, round({_V}, 6) AS volume, round(mass / {_V}, 9) AS density FROM h")
