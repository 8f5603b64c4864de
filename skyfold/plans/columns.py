"""Scans and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import joined, with_offsets
from ..conf import EngineConf
from ..operators.aggregates import total
from ..shared import shared_folder
from ..units import BOLTZMANN, ELECTRON, PROTON
from . import fixture as x
from .fixture import G, K, lit

QUERIES: dict[str, x.Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: x.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _derived(name: str, key: str, sql: str, digits: int | None = None) -> None:
    def query(spark, sf_dir):
        snap = x.gas(spark, sf_dir)
        value = snap.col(key)
        return snap.types[0].select(*x.KEYS, (F.round(value, digits) if digits is not None else value).alias("value"))

    add(name, query, f"WITH {G} SELECT {K}, {f'round({sql}, {digits})' if digits is not None else sql} AS value FROM g")


C = lit(x.GAMMA - 1)
MU = "(4e0 / ((1e0 + 3e0 * metal) + 4e0 * metal * ne))"
TEMP = f"(u * {MU} * {lit((x.GAMMA - 1) * (ELECTRON + PROTON) / BOLTZMANN * 1e5**2)})"
B2 = "(bx * bx + by_ * by_ + bz * bz)"


def _g(k: int, times: float) -> str:
    return f"({('vx', 'vy', 'vz')[k % 3]} * {lit(times * (k + 1))})"


def _curl(t: float) -> tuple[str, str, str]:
    return f"({_g(7, t)} - {_g(5, t)})", f"({_g(2, t)} - {_g(6, t)})", f"({_g(3, t)} - {_g(1, t)})"


def _norm2(c) -> str:
    return f"({c[0]} * {c[0]} + {c[1]} * {c[1]} + {c[2]} * {c[2]})"


def _curvature(b: tuple[str, str, str], t: float) -> str:
    along = [f"({_g(3 * k, t)} * {b[0]} + {_g(3 * k + 1, t)} * {b[1]} + {_g(3 * k + 2, t)} * {b[2]})" for k in range(3)]
    size = _norm2(b)
    both = f"({b[0]} * {along[0]} + {b[1]} * {along[1]} + {b[2]} * {along[2]})"
    out = [f"({along[k]} / {size} - {b[k]} * {both} / ({size} * {size}))" for k in range(3)]
    return f"(CASE WHEN {size} > 0 THEN sqrt({_norm2(out)}) END)"


_derived("D1_metallicity_mass", "0_GFM_MetallicityTimesMasses", "m * metal")
_derived("D2_volume", "0_Volume", "m / rho")
_derived("D3_mach_dissipation", "0_MachnumberTimesEnergyDissipation", "mach * diss")
_derived("D4_field_squared", "0_MagneticFieldSquared", B2)
_derived("D5_field_strength", "0_MagneticFieldStrength", f"sqrt{B2}")
_derived("D6_speed", "0_VelocityMagnitude", "sqrt(vx * vx + vy * vy + vz * vz)")
_derived("D7_field_squared_volume", "0_MagneticFieldSquaredTimesVolume", f"(m / rho) * {B2}")
_derived("D8_pressure", "0_Pressure", f"{C} * u * rho")
_derived("D9_pressure_volume", "0_PressureTimesVolume", f"{C} * m * u")
_derived("D10_temperature", "0_Temperatures", TEMP)
_derived("D11_temperature_mass", "0_TemperaturesTimesMasses", f"{TEMP} * m")
_derived("D12_current", "0_Current", f"sqrt{_norm2(_curl(1.0))}")
_derived("D13_enstrophy", "0_Enstrophy", f"0.5e0 * {_norm2(_curl(2.0))}")
_derived("D14_enstrophy_mass", "0_EnstrophyTimesMasses", f"(0.5e0 * {_norm2(_curl(2.0))}) * m")
_derived("D15_molecular_weight", "0_MeanMolecularWeight", MU)
_derived("D17_magnetic_curvature", "0_MagneticCurvature", _curvature(("bx", "by_", "bz"), 1.0))
_derived("D18_velocity_curvature", "0_VelocityCurvature", _curvature(("vx", "vy", "vz"), 2.0))
_derived("D19_diameter", "0_Diameters", f"2e0 * cbrt((m / rho) / {lit(4 * 3.141592653589793 / 3)})", 6)


def _number_density(spark, sf_dir):
    snap = x.gas(spark, sf_dir)
    return snap.types[0].select(*x.KEYS, snap.col("0_NumberDensity").alias("value"))


_RHO = 1.989e43 / 3.0856775814913674e21**3 * 0.7**2.0 * 0.5**-3.0 / PROTON
add("D16_number_density", _number_density, f"WITH {G} SELECT {K}, rho * {lit(_RHO)} / {MU} AS value FROM g")


def _user_function(spark, sf_dir):
    conf = EngineConf()
    conf.add_user_function("0_TemperaturesTimesMassesSquared", lambda s: s["0_TemperaturesTimesMasses"] * s["0_Masses"], ("0_TemperaturesTimesMasses", "0_Masses"))
    conf.set_aliases({"0_TemperaturesTimesMassesSquared": "TM2"})
    return x.gas(spark, sf_dir, conf).frame(0, "TM2", extra=x.KEYS).withColumnRenamed("TM2", "value")


add("X1_user_function", _user_function, f"WITH {G} SELECT {K}, {TEMP} * m * m AS value FROM g")


def _scan(spark, sf_dir):
    return x.gas(spark, sf_dir).frame(0, "0_Masses", "0_Density", "0_InternalEnergy", extra=x.KEYS).withColumnsRenamed({"Masses": "mass", "Density": "density", "InternalEnergy": "energy"})


add("S3_scan_columns", _scan, f"WITH {G} SELECT {K}, m AS mass, rho AS density, u AS energy FROM g")


def _physical(spark, sf_dir):
    return x.gas(spark, sf_dir).frame(0, "0_Masses", extra=x.KEYS, to_physical=True).withColumnRenamed("Masses", "value")


add("S1_to_physical_scan", _physical, f"WITH {G} SELECT {K}, m * {lit(0.7**-1.0 * 0.5**0.0)} AS value FROM g")


def _ranges(spark, sf_dir):
    """Lines in order of their keys as particles; each order's rows by its offset and length."""
    return with_offsets(x.groups(spark, sf_dir).select("o_orderkey", "length"), "o_orderkey", "length").select("o_orderkey", "length", "first", "last")


_OFFSETS = "o AS (SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS length FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey), off AS (SELECT o_orderkey, length, CAST(sum(length) OVER (ORDER BY o_orderkey) AS BIGINT) AS last FROM o)"
add("S5_group_offsets", _ranges, f"WITH {_OFFSETS} SELECT o_orderkey, length, last - length AS first, last FROM off")


def _offset_join(spark, sf_dir):
    """Supposing parts to be particles in order of their keys, the order that each belongs to by offset."""
    rows = x.table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("row_id"), "p_retailprice")
    return joined(rows, _ranges(spark, sf_dir), "o_orderkey").groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), total(F.col("p_retailprice"), 4).alias("total"))


add("J1_offset_join", _offset_join, f"WITH {_OFFSETS} SELECT o_orderkey AS object_id, count(*) AS n, {x.dsum('p_retailprice')} AS total FROM off JOIN part ON p_partkey - 1 >= last - length AND p_partkey - 1 < last GROUP BY o_orderkey")


def _top(spark, sf_dir):
    from ..catalog import heaviest

    return heaviest(x.catalog(spark, sf_dir).groups.select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), 10, F.col("o_orderkey"))


add("S6_catalog_scan", lambda spark, sf_dir: x.catalog(spark, sf_dir).groups.select("o_orderkey", "o_custkey", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
add("A14_heaviest_groups", _top, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


def _first_file(spark, sf_dir):
    from ..catalog import Catalog

    rows = x.table(spark, sf_dir, "orders").withColumn("file_no", F.floor(F.col("o_orderkey") / 1000))
    return Catalog(rows, None).first_file().groups.select("o_orderkey", "o_totalprice")


add("S7_first_file", _first_file, "SELECT o_orderkey, o_totalprice FROM orders WHERE floor(o_orderkey / 1000e0) = 0")


def _mass_table(spark, sf_dir):
    from ..snapshot import Snapshot

    snap = Snapshot({3: x.table(spark, sf_dir, "supplier")}, x.HEADER, x.PARAMETERS)
    return snap.frame(3, "3_Masses", extra=["s_suppkey"]).withColumnRenamed("Masses", "mass")


add("S10_mass_table", _mass_table, "SELECT s_suppkey, 2.5e0 AS mass FROM supplier")


def _generic(spark, sf_dir):
    from ..sources.store import Generic

    rows = x.table(spark, sf_dir, "part")
    snap = Generic(rows).give_info(100.0).set_positions(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(0.0)).set_volumes(F.col("p_retailprice") * 2.0).set_data("Masses", F.col("p_size") * 1.0).open()
    return snap.types[0].select("p_partkey", snap["0_Coordinates"]["y"].alias("y"), snap["0_Volume"].alias("volume"), (snap["0_Masses"] / snap["0_Volume"]).alias("density"))


add("S11_generic_source", _generic, "SELECT p_partkey, p_retailprice AS y, p_retailprice * 2e0 AS volume, (p_size * 1e0) / (p_retailprice * 2e0) AS density FROM part")


def _round_trip(spark, sf_dir):
    """Writes a reduced snapshot, reads it back and sums what came."""
    import uuid

    from ..operators.neighbors import _kept
    from ..sources.store import Reader, save_snapshot

    snap = x.gas(spark, sf_dir)
    folder = shared_folder(spark)
    base = f"reduced-{uuid.uuid4().hex}"
    df = snap.types[0].withColumn("row_id", F.col("l_orderkey"))
    snap = snap._with({0: df})
    save_snapshot(spark, snap, folder, base, 7, ["0_Coordinates", "0_Masses", "0_Density"])
    back = Reader(spark, folder, 7, base).snapshot()
    out = back.types[0].groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), total(back["0_Masses"], 4).alias("mass"), F.max(back["0_Volume"]).alias("volume"))
    return _kept(out)


add("S18_write_and_read", _round_trip, f"WITH {G} SELECT l_orderkey AS row_id, count(*) AS n, {x.dsum('m')} AS mass, max(m / rho) AS volume FROM g GROUP BY l_orderkey")
