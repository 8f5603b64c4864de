"""Neighbours, images, unit conversions and time series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import deposit, neighbors, slices
from ..operators.camera import Camera
from ..timeseries import TimeSeries
from ..units import CodeUnits, Quantity, Unit
from . import fixture as x
from .fixture import CLOUD, G, K, SERIES, dsum, lit

QUERIES: dict[str, x.Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: x.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# -- neighbours

D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _nearest_self(spark, sf_dir):
    points = x.cloud(spark, sf_dir)
    return neighbors.nearest(points, points.withColumnRenamed("id", "qid"), ignore_self=True)


add("J2_nearest_not_self", _nearest_self, f"WITH {CLOUD} SELECT qid, id, d2 FROM (SELECT a.id AS qid, b.id AS id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM p a JOIN p b ON {D2} > 0) WHERE r = 1")


def _nearest_self_joined(spark, sf_dir):
    """As for more points than are sent to the tasks: joins on cells."""
    points = x.cloud(spark, sf_dir)
    return neighbors.nearest(points, points.withColumnRenamed("id", "qid"), ignore_self=True, sent_points=0)


add("J2_nearest_joined", _nearest_self_joined, ORACLES["J2_nearest_not_self"])


def _nearest_of_sorted(spark, sf_dir):
    """Points in the order of their Morton keys are found under their own ids."""
    points = x.cloud(spark, sf_dir)
    return neighbors.nearest(neighbors.clustered(points, "pos", 4), points.withColumnRenamed("id", "qid"), ignore_self=True)


add("T10_ids_of_sorted_points", _nearest_of_sorted, ORACLES["J2_nearest_not_self"])


def _lattice(spark):
    n = 12
    c = [(F.col("id") % n), (F.floor(F.col("id") / n) % n), F.floor(F.col("id") / (n * n))]
    return spark.range(n**3).select(F.col("id").alias("qid"), F.struct(*[(F.lit(-0.55) + v * F.lit(0.1)).alias(k) for k, v in zip("xyz", c)]).alias("pos"))


_GRID = "q AS (SELECT i AS id, -0.55e0 + (i % 12) * 0.1e0 AS x, -0.55e0 + ((i // 12) % 12) * 0.1e0 AS y, -0.55e0 + (i // 144) * 0.1e0 AS z FROM range(1728) t(i))"
add("J8_nearest_of_grid", lambda spark, sf_dir: neighbors.nearest(x.cloud(spark, sf_dir), _lattice(spark)), f"WITH {CLOUD}, {_GRID} SELECT qid, id, d2 FROM (SELECT a.id AS qid, b.id AS id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM q a CROSS JOIN p b) WHERE r = 1")
add("J3_radius_search", lambda spark, sf_dir: neighbors.within(x.cloud(spark, sf_dir), _lattice(spark), 0.08), f"WITH {CLOUD}, {_GRID} SELECT a.id AS qid, b.id AS id, {D2} AS d2 FROM q a JOIN p b ON {D2} <= {lit(0.08 * 0.08)}")
add("J3_radius_search_capped", lambda spark, sf_dir: neighbors.within(x.cloud(spark, sf_dir), _lattice(spark), 0.15, most=3), f"WITH {CLOUD}, {_GRID} SELECT qid, id, d2, n_all FROM (SELECT a.id AS qid, b.id AS id, {D2} AS d2, count(*) OVER (PARTITION BY a.id) AS n_all, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM q a JOIN p b ON {D2} <= {lit(0.15 * 0.15)}) WHERE r <= 3")

add("J8_nearest_of_grid_joined", lambda spark, sf_dir: neighbors.nearest(x.cloud(spark, sf_dir), _lattice(spark), sent_points=0), ORACLES["J8_nearest_of_grid"])
add("J3_radius_search_joined", lambda spark, sf_dir: neighbors.within(x.cloud(spark, sf_dir), _lattice(spark), 0.08, sent_points=0), ORACLES["J3_radius_search"])
add("J3_radius_capped_joined", lambda spark, sf_dir: neighbors.within(x.cloud(spark, sf_dir), _lattice(spark), 0.15, most=3, sent_points=0), ORACLES["J3_radius_search_capped"])


def _morton(spark, sf_dir):
    points = x.cloud(spark, sf_dir)
    ix, iy, iz = neighbors.scaled_cells(points, F.col("pos"))
    keyed = points.select("id", ix.alias("ix"), iy.alias("iy"), iz.alias("iz")).withColumn("key", neighbors.morton_key(F.col("ix"), F.col("iy"), F.col("iz")))
    back = neighbors.morton_decode(F.col("key"))
    return keyed.select("id", "ix", "iy", "iz", "key", *[b.alias(f"back_{n}") for n, b in zip("xyz", back)])


_BITS = "CAST(list_sum(list_transform(range(21), lambda k: (((ix >> k) & 1) << (3 * k + 2)) + (((iy >> k) & 1) << (3 * k + 1)) + (((iz >> k) & 1) << (3 * k)))) AS BIGINT)"
add("T2_morton_key", _morton, f"WITH {CLOUD}, e AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM p), i AS (SELECT id, CAST(floor((x - lx) / side * 2097151e0) AS BIGINT) AS ix, CAST(floor((y - ly) / side * 2097151e0) AS BIGINT) AS iy, CAST(floor((z - lz) / side * 2097151e0) AS BIGINT) AS iz FROM p, e) SELECT id, ix, iy, iz, {_BITS} AS key, ix AS back_x, iy AS back_y, iz AS back_z FROM i")

# -- deposition

PLAIN = Camera((25.0, 25.0, 25.0), (40.0, 40.0, 44.0), "z", 32)
TURNED = Camera((25.0, 25.0, 25.0), (30.0, 30.0, 30.0), x.TILTED, 32)
FINE = Camera((25.0, 25.0, 25.0), (48.0, 48.0, 60.0), "z", 64)
SIZE = "(1.2e0 + ne * 20e0)"


def _size():
    return F.lit(1.2) + F.col("ElectronAbundance") * F.lit(20.0)


def _deposit_sql(camera: Camera, u: str, v: str, where: str, reach: int) -> str:
    nx, ny = camera.npix_width, camera.npix_height
    return f"""i AS (SELECT row_number() OVER () AS id, ({u} + {lit(camera.width / 2)}) * {lit(nx / camera.width)} AS px, ({v} + {lit(camera.height / 2)}) * {lit(ny / camera.height)} AS py, greatest({SIZE} * {lit(nx / camera.width)}, 1e0) AS h, m FROM g WHERE {where}),
j AS (SELECT *, CAST(trunc(px) AS BIGINT) + o.k AS ix, CAST(trunc(py) AS BIGINT) + r.k AS iy FROM i, range(-{reach}, {reach}) o(k), range(-{reach}, {reach}) r(k) WHERE o.k >= -(CAST(trunc(h) AS BIGINT) + 1) AND o.k < CAST(trunc(h) AS BIGINT) + 1 AND r.k >= -(CAST(trunc(h) AS BIGINT) + 1) AND r.k < CAST(trunc(h) AS BIGINT) + 1),
w AS (SELECT id, ix, iy, m, greatest(1e0 - ((px - (ix + 0.5e0)) * (px - (ix + 0.5e0)) + (py - (iy + 0.5e0)) * (py - (iy + 0.5e0))) / (h * h), 0e0) AS s FROM j),
n AS (SELECT *, sum(s) OVER (PARTITION BY id) AS norm FROM w)
SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, CAST(sum(CAST(floor(s * (m / norm) * 1e6 + 0.5e0) AS BIGINT)) AS BIGINT) AS value FROM n WHERE s > 0 AND ix >= 0 AND ix < {nx} AND iy >= 0 AND iy < {ny} GROUP BY iy, ix"""


def _project(camera: Camera):
    return lambda spark, sf_dir: deposit.project(x.particles(spark, sf_dir), camera, F.col("Coordinates"), _size(), F.col("Masses"), per_area=False, micro=True)


_IN = "abs(x - 25e0) < 20e0 AND abs(y - 25e0) < 20e0 AND abs(z - 25e0) < 22e0"
add("P2_project", _project(PLAIN), f"WITH {G}, {_deposit_sql(PLAIN, '(x - 25e0)', '(y - 25e0)', _IN, 6)}")
_D = [f"({c} - 25e0)" for c in "xyz"]
_R = [f"({_D[0]} * {lit(r[0])} + {_D[1]} * {lit(r[1])} + {_D[2]} * {lit(r[2])})" for r in x.TILTED.inverse]
add("P3_project_oriented", _project(TURNED), f"WITH {G}, {_deposit_sql(TURNED, _R[0], _R[1], ' AND '.join(f'abs({r}) < 15e0' for r in _R), 6)}")


def _reselected(spark, sf_dir):
    """A camera that moves and zooms selects anew; the rows of the first one are not narrowed further."""
    rows = x.particles(spark, sf_dir)
    views = [("first", PLAIN), ("zoomed", PLAIN.zoom(2.0)), ("moved", PLAIN.zoom(2.0).move(width=5.0, height=-5.0)), ("back", PLAIN.zoom(2.0).zoom(0.5))]
    return rows.select(*[F.sum(c.region(F.col("Coordinates")).cast("long")).alias(n) for n, c in views])


_VIEW = "CAST(sum(CASE WHEN abs(x - {0}e0) < {2}e0 AND abs(y - {1}e0) < {2}e0 AND abs(z - 25e0) < {3}e0 THEN 1 ELSE 0 END) AS BIGINT)"
add("P13_reselection", _reselected, f"WITH {G} SELECT {_VIEW.format(25, 25, 20, 22)} AS first, {_VIEW.format(25, 25, 10, 11)} AS zoomed, {_VIEW.format(30, 20, 10, 11)} AS moved, {_VIEW.format(25, 25, 20, 22)} AS back FROM g")


def _nested(spark, sf_dir):
    """Whole millionths shared out by powers of four are exact, so the image does not depend on order."""
    return deposit.project_nested(x.particles(spark, sf_dir), FINE, F.col("Coordinates"), _size(), F.col("Masses"), factor=2, npix_min=8, per_area=False, micro=True)


#: Kernels up to 3.2 on a width of 48: grids of 32 and 64 pixels, parted at a kernel of 3.
def _level_sql(npix: int, k: int, where: str) -> str:
    inside = "abs(x - 25e0) < 24e0 AND abs(y - 25e0) < 24e0 AND abs(z - 25e0) < 30e0"
    grid = Camera(FINE.center, FINE.widths, "z", npix)
    rows = _deposit_sql(grid, "(x - 25e0)", "(y - 25e0)", f"{inside} AND {where}", 6)
    return f"SELECT iy * {k} + dy AS iy, ix * {k} + dx AS ix, CAST(value AS DOUBLE) / {k * k}e0 AS value FROM (WITH {G}, {rows}), range({k}) a(dy), range({k}) b(dx)"


add("P4_project_nested", _nested, f"SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, sum(value) AS value FROM ({_level_sql(32, 2, f'{SIZE} >= 3e0')} UNION ALL {_level_sql(64, 1, f'{SIZE} < 3e0')}) GROUP BY iy, ix")


def _ratio(spark, sf_dir):
    rows = x.particles(spark, sf_dir)
    image = lambda v: deposit.project(rows, PLAIN, F.col("Coordinates"), _size(), v, per_area=False, micro=True)
    return deposit.ratio(image(F.col("Masses")), image(F.col("Density")))


_TOP = f"t AS (SELECT * FROM (WITH {G}, {_deposit_sql(PLAIN, '(x - 25e0)', '(y - 25e0)', _IN, 6)}))"
_LOW = f"l AS (SELECT * FROM (WITH {G.replace('l_quantity AS m', '1e0 + l_tax * 100e0 AS m')}, {_deposit_sql(PLAIN, '(x - 25e0)', '(y - 25e0)', _IN, 6)}))"
add("D25_image_ratio", _ratio, f"WITH {_TOP}, {_LOW} SELECT t.iy, t.ix, CASE WHEN l.value <> 0 THEN CAST(t.value AS DOUBLE) / CAST(l.value AS DOUBLE) END AS value FROM t JOIN l ON t.iy = l.iy AND t.ix = l.ix")

# -- slices and rays on the point cloud; each point is a cell of equal volume

FLAT = Camera((0.0, 0.0, 0.02), (0.4, 0.4, 0.0), "z", 16)
DEEP = Camera((0.0, 0.0, 0.02), (0.4, 0.4, 0.4), "z", 8)
VOLUME = 0.001
_REACH = 4 * (VOLUME / (4 * math.pi / 3)) ** (1 / 3)


def _reach_sql(depth: float) -> str:
    return f"c AS (SELECT * FROM p WHERE abs(x - 0e0) < 0.2e0 + {lit(_REACH)} AND abs(y - 0e0) < 0.2e0 + {lit(_REACH)} AND abs(z - 0.02e0) < {depth / 2}e0 + {lit(_REACH)})"


def _pixel_sql(camera: Camera, n: int) -> str:
    nx, ny = camera.npix_width, camera.npix_height
    return f"""q AS (SELECT CAST(i // {n * nx} AS INTEGER) AS iy, CAST((i // {n}) % {nx} AS INTEGER) AS ix, CAST(i % {n} AS INTEGER) AS iz FROM range({nx * ny * n}) t(i)),
a AS (SELECT iy, ix, iz, 0e0 + ({lit(-camera.width / 2)} + (ix + 0.5e0) * {lit(camera.width / nx)}) AS x, 0e0 + ({lit(-camera.height / 2)} + (iy + 0.5e0) * {lit(camera.height / ny)}) AS y, 0.02e0 + ({lit(-camera.depth / 2)} + (iz + 0.5e0) * {lit(camera.depth / n)}) AS z FROM q),
f AS (SELECT iy, ix, iz, value FROM (SELECT a.iy, a.ix, a.iz, b.value, row_number() OVER (PARTITION BY a.iy, a.ix, a.iz ORDER BY {D2}, b.id) AS r FROM a CROSS JOIN c b) WHERE r = 1)"""


def _slice(**more):
    return lambda spark, sf_dir: slices.slice_image(x.cloud(spark, sf_dir), FLAT, "pos", "id", F.lit(VOLUME), {"value": F.col("value")}, **more)


add("P5_slice", _slice(), f"WITH {CLOUD}, {_reach_sql(0.0)}, {_pixel_sql(FLAT, 1)} SELECT iy, ix, value FROM f")

add("P5_slice_joined", _slice(sent_points=0), ORACLES["P5_slice"])


def _stack(additive: bool):
    return lambda spark, sf_dir: slices.stack_image(x.cloud(spark, sf_dir), DEEP, "pos", "id", F.lit(VOLUME), {"value": F.col("value")}, additive, 8).withColumn("value", F.round("value", 6))


add("P6_stack_mean", _stack(False), f"WITH {CLOUD}, {_reach_sql(0.4)}, {_pixel_sql(DEEP, 8)} SELECT iy, ix, round(avg(value), 6) AS value FROM f GROUP BY iy, ix")
add("P6_stack_additive", _stack(True), f"WITH {CLOUD}, {_reach_sql(0.4)}, {_pixel_sql(DEEP, 8)} SELECT iy, ix, round(sum(value / {lit(VOLUME)}) * {lit(0.4 / 8)}, 6) AS value FROM f GROUP BY iy, ix")


def _rays(**more):
    def query(spark, sf_dir):
        out = slices.ray_march(x.cloud(spark, sf_dir), DEEP, "pos", "id", F.lit(VOLUME), {"value": F.col("value"), "ones": F.lit(1.0)}, tol=0.5, **more)
        return out.select("iy", "ix", F.round("value", 6).alias("value"), F.round("ones", 9).alias("ones"))

    return query


#: Equal volumes make equal steps, so the march is a sum over known places, the last step cut at the depth.
_STEP = 0.5 * 2.4 * (VOLUME / (4 * math.pi / 3)) ** (1 / 3)
_N = math.ceil(0.4 / _STEP)
_WIDTHS = [min(_STEP, 0.4 - k * _STEP) for k in range(_N)]
_PLACES = ", ".join(f"({k}, {lit(k * _STEP)}, {lit(w)})" for k, w in enumerate(_WIDTHS))
add(
    "P7_ray_march",
    _rays(),
    f"""WITH {CLOUD}, {_reach_sql(0.4)}, steps(iz, dz, w) AS (VALUES {_PLACES}),
a AS (SELECT CAST(i // 8 AS INTEGER) AS iy, CAST(i % 8 AS INTEGER) AS ix, iz, w, {lit(-0.2)} + (i % 8 + 0.5e0) * {lit(0.05)} AS x, {lit(-0.2)} + (i // 8 + 0.5e0) * {lit(0.05)} AS y, 0.02e0 - 0.2e0 + dz AS z FROM range(64) t(i), steps),
f AS (SELECT iy, ix, w, value FROM (SELECT a.iy, a.ix, a.iz, a.w, b.value, row_number() OVER (PARTITION BY a.iy, a.ix, a.iz ORDER BY {D2}, b.id) AS r FROM a CROSS JOIN c b) WHERE r = 1)
SELECT iy, ix, round(sum(w * value) / 0.4e0, 6) AS value, round(sum(w) / 0.4e0, 9) AS ones FROM f GROUP BY iy, ix""",
)

#: Several values are one march, and a march in one task is no other one.
QUERIES["P8_many_values"], ORACLES["P8_many_values"] = QUERIES["P7_ray_march"], ORACLES["P7_ray_march"]
add("P9_serial_march", lambda spark, sf_dir: _rays()(spark, sf_dir).coalesce(1), ORACLES["P7_ray_march"])
add("P7_ray_march_tiled", _rays(sent_points=0), ORACLES["P7_ray_march"])
#: Steps of twice ``tol`` times the distance to the nearest cell; no SQL, tested against a plain march.
add("P11_march_by_distance", lambda spark, sf_dir: slices.ray_march(x.cloud(spark, sf_dir), DEEP, "pos", "id", F.lit(VOLUME), {"value": F.col("value")}, tol=0.5, gas=False))


def _pixels(spark, sf_dir):
    return PLAIN.pixels(spark).select("iy", "ix", F.col("pos.x").alias("x"), F.col("pos.y").alias("y"))


add("P15_pixel_grid", _pixels, f"SELECT CAST(i // 32 AS INTEGER) AS iy, CAST(i % 32 AS INTEGER) AS ix, 25e0 + (-20e0 + (i % 32 + 0.5e0) * 1.25e0) AS x, 25e0 + (-20e0 + (i // 32 + 0.5e0) * 1.25e0) AS y FROM range(1024) t(i)")

# -- units

CODE = CodeUnits(x.PARAMETERS["UnitLength_in_cm"], x.PARAMETERS["UnitMass_in_g"], x.PARAMETERS["UnitVelocity_in_cm_per_s"])
A, H = 0.5, 0.7


def _unit(name: str, convert, factor: float) -> None:
    def query(spark, sf_dir):
        q = convert(Quantity(F.col("Density"), "code_density small_h2 / small_a3", A, H, True, CODE))
        return x.particles(spark, sf_dir).select(*x.KEYS, q.value.alias("value"))

    add(name, query, f"WITH {G} SELECT {K}, rho * {lit(factor)} AS value FROM g")


_RHO = Unit.parse("code_density", CODE).scale
_ASTRO = Unit.parse("Msun / kpc3").scale
_unit("U1_no_small_h", lambda q: q.no_small_h, H**2.0)
_unit("U2_to_physical", lambda q: q.to_physical, H**2.0 * A**-3.0)
_unit("U3_to_comoving", lambda q: q.to_comoving("code_density small_h2 / small_a"), 1.0 * A ** (-3.0 + 1.0) * H**0.0)
_unit("U4_to_unit", lambda q: q.to("Msun / kpc3"), _RHO / _ASTRO)
_unit("U5_to_any", lambda q: q.to_any("Msun / kpc3"), _RHO / _ASTRO * A**-3.0 * H**2.0)
_unit("U6_cgs", lambda q: q.cgs, _RHO / 1.0)
_unit("U7_adjust_time", lambda q: q.adjust_time(a=0.25), (0.5 / 0.25) ** -3.0)
add("U7_set_time", lambda spark, sf_dir: x.particles(spark, sf_dir).select(*x.KEYS, Quantity(F.col("Density"), "code_density", A, H).set_time(z=3.0).value.alias("value")), f"WITH {G} SELECT {K}, rho AS value FROM g")

# -- time series


def _series(spark, sf_dir):
    return TimeSeries.of(x.series(spark, sf_dir), "code_length small_a / small_h", H)


add("M7_series_to_physical", lambda spark, sf_dir: _series(spark, sf_dir).to_physical().df.select("event_id", "a", F.round("value", 6).alias("value")), f"WITH {SERIES} SELECT event_id, a, round(value * ({lit(H**-1.0)} * a), 6) AS value FROM s")


def _reduce(spark, sf_dir):
    s = _series(spark, sf_dir)
    whole = TimeSeries(s.df.withColumn("value", F.floor(F.col("value") * 1e4 + 0.5).cast("decimal(28,0)")), s.unit, s.h)
    return whole.reduce_time("sum").select((F.col("value").cast("double") / 1e4).alias("total")).crossJoin(s.reduce_time("max").select(F.col("value").alias("top")))


add("A15_series_reductions", _reduce, f"WITH {SERIES} SELECT {dsum('value')} AS total, max(value) AS top FROM s")


def _rows(spark, sf_dir):
    pair = x.series(spark, sf_dir).withColumn("value", F.array("value", F.col("value") * 2.0, F.lit(1.0)))
    s = TimeSeries.of(pair, "code_length")
    return s.reduce_rows("sum").df.select("event_id", F.col("value").alias("total"))


add("A15_series_row_sums", _rows, f"WITH {SERIES} SELECT event_id, 0e0 + value + value * 2e0 + 1e0 AS total FROM s")
add("U13_series_slice", lambda spark, sf_dir: _series(spark, sf_dir).between(0.25, 0.5).df, f"WITH {SERIES} SELECT event_id, a, value FROM s WHERE a >= 0.25e0 AND a < 0.5e0")


def _concat(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.between(0.0, 0.2).concat(s.between(0.8, 2.0)).df


add("U14_series_concat", _concat, f"WITH {SERIES} SELECT event_id, a, value FROM s WHERE (a >= 0 AND a < 0.2e0) OR (a >= 0.8e0 AND a < 2)")


def _stacked(spark, sf_dir):
    s = x.series(spark, sf_dir).groupBy("a").agg(F.max("value").alias("value"), F.min("value").alias("low"))
    left, right = TimeSeries.of(s.select("a", "value"), "code_length"), TimeSeries.of(s.select("a", F.col("low").alias("value")), "code_length")
    return left.stack(right).df.select("a", F.col("value")[0].alias("high"), F.col("value")[1].alias("low"))


add("U14_series_stack", _stacked, f"WITH {SERIES} SELECT a, max(value) AS high, min(value) AS low FROM s GROUP BY a")


def _union(spark, sf_dir):
    return x.by_type(spark, sf_dir)._together(None, "Masses").groupBy("parttype").count().withColumnRenamed("count", "n")


add("S3_types_union", _union, f"WITH {G} SELECT CAST(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS INTEGER) AS parttype, count(*) AS n FROM g GROUP BY l_returnflag")

