"""The provided tables as a snapshot, a catalogue, a point cloud and a time series; the same bindings as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..conf import EngineConf
from ..functions.vectors import GRADIENT, vec
from ..orientation import Orientation
from ..snapshot import Snapshot

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
CENTER = (25.0, 25.0, 25.0)
GAMMA = 5 / 3
PARAMETERS = {"HubbleParam": 0.7, "ComovingIntegrationOn": 1, "Omega0": 0.3, "OmegaLambda": 0.7, "OmegaBaryon": 0.05, "UnitLength_in_cm": 3.0856775814913674e21, "UnitMass_in_g": 1.989e43, "UnitVelocity_in_cm_per_s": 1e5}
HEADER = {"Time": 0.5, "Redshift": 1.0, "BoxSize": 50.0, "MassTable": [0.0, 0.0, 0.0, 2.5]}
TILTED = Orientation(normal=(1, 2, 3)).rotate_around_normal(degrees=20).rotate_around_perp1(degrees=35).rotate_around_perp2(degrees=-47)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as gas: positions of about 0 to 50 on each axis."""
    q = F.col("l_quantity") / F.lit(50.0)
    base = [F.col("l_tax"), F.col("l_discount"), q]

    def gradient(times: float):
        return F.struct(*[(base[k % 3] * F.lit(times * (k + 1))).alias(n) for k, n in enumerate(GRADIENT)])

    return table(spark, sf_dir, "lineitem").select(
        *KEYS,
        "l_returnflag",
        vec(F.col("l_quantity"), F.col("l_extendedprice") / F.lit(2100.0), F.col("l_discount") * F.lit(500.0)).alias("Coordinates"),
        F.col("l_quantity").alias("Masses"),
        (F.lit(1.0) + F.col("l_tax") * F.lit(100.0)).alias("Density"),
        vec(F.col("l_tax"), F.col("l_discount"), q).alias("Velocities"),
        vec(F.col("l_discount"), F.col("l_tax"), q).alias("MagneticField"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("InternalEnergy"),
        F.col("l_discount").alias("ElectronAbundance"),
        F.array(F.col("l_tax")).alias("GFM_Metals"),
        F.col("l_tax").alias("GFM_Metallicity"),
        F.col("l_linenumber").cast("double").alias("Machnumber"),
        F.col("l_extendedprice").alias("EnergyDissipation"),
        gradient(1.0).alias("BfieldGradient"),
        gradient(2.0).alias("VelocityGradient"),
    )


def gas(spark: SparkSession, sf_dir: str, conf: EngineConf | None = None) -> Snapshot:
    """All of lineitem as type 0."""
    return Snapshot({0: particles(spark, sf_dir)}, HEADER, PARAMETERS, {"GAMMA": GAMMA}, conf)


def by_type(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Type 0 is returnflag N, 1 is A, 2 is R."""
    df = particles(spark, sf_dir)
    types = {t: df.filter(F.col("l_returnflag") == f).select(*KEYS, "Coordinates", "Velocities", "Masses") for t, f in enumerate("NAR")}
    return Snapshot(types, HEADER, PARAMETERS, {"GAMMA": GAMMA})


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as groups; the length of a group is its count of lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", "o_custkey", "o_totalprice", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(table(spark, sf_dir, "orders"), None, HEADER, PARAMETERS)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components of the embeddings as points without ties."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec(e[0].cast("double"), e[1].cast("double"), e[2].cast("double")).alias("pos"), F.col("label").cast("double").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of whole ids as values along a."""
    return table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 1000 + 1) / F.lit(1000.0)).alias("a"), "value")


G = """g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag, l_quantity AS x, l_extendedprice / 2100e0 AS y,
 l_discount * 500e0 AS z, l_quantity AS m, 1e0 + l_tax * 100e0 AS rho, l_tax AS vx, l_discount AS vy, l_quantity / 50e0 AS vz, l_discount AS bx, l_tax AS by_, l_quantity / 50e0 AS bz,
 l_extendedprice / 1000e0 AS u, l_discount AS ne, l_tax AS metal, CAST(l_linenumber AS DOUBLE) AS mach, l_extendedprice AS diss FROM lineitem)"""
K = ", ".join(KEYS)
CLOUD = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS DOUBLE) AS value FROM embeddings)"
SERIES = "s AS (SELECT event_id, (event_id % 1000 + 1) / 1000e0 AS a, value FROM events)"


def lit(x: float) -> str:
    """A double literal that DuckDB reads exactly."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def dsum(expr: str, digits: int = 4) -> str:
    """Sum of terms rounded to whole numbers of 10^-digits, as the engine's exact sums are."""
    return f"(CAST(sum(CAST(floor(({expr}) * 1e{digits} + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e{digits})"
