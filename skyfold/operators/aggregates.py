"""Sums, centres of mass and angular momenta, each one aggregation with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import AXES, less, parts


def total(c: Column, exact: int | None = None) -> Column:
    """Sum of a column. With ``exact``, each term is rounded to that many digits after the point and summed as a whole number, so that the order of the rows does not matter; terms stay below 9e18 / 10^exact."""
    if exact is None:
        return F.sum(c)
    scale = float(10**exact)
    return F.sum(F.floor(c * F.lit(scale) + F.lit(0.5)).cast("decimal(28,0)")).cast("double") / F.lit(scale)


def _by(df: DataFrame, by: Sequence[str | Column]):
    return df.groupBy(*by)


def sum_of(df: DataFrame, column: Column, by: Sequence[str | Column] = (), exact: int | None = None) -> DataFrame:
    """Sum of a number column as ``total``, or of a vector column as x, y, z."""
    kind = df.select(column.alias("c")).schema["c"].dataType
    if kind.typeName() == "struct":
        return _by(df, by).agg(*[total(column[n], exact).alias(n) for n in kind.names])
    return _by(df, by).agg(total(column, exact).alias("total"))


def weighted_sum(df: DataFrame, weight: Column, vector: Column, by: Sequence[str | Column] = (), exact: int | None = None) -> DataFrame:
    """Sum of weight times vector."""
    return _by(df, by).agg(*[total(weight * c, exact).alias(n) for n, c in zip(AXES, parts(vector))])


def center_of_mass(df: DataFrame, mass: Column, pos: Column, by: Sequence[str | Column] = (), exact: int | None = None) -> DataFrame:
    """Mass and its centre for each group; no mass gives nulls."""
    sums = _by(df, by).agg(total(mass, exact).alias("mass"), *[total(mass * c, exact).alias(f"__{n}") for n, c in zip(AXES, parts(pos))])
    keys = [c for c in sums.columns if c != "mass" and not c.startswith("__")]
    return sums.select(*keys, "mass", *[F.try_divide(F.col(f"__{n}"), F.col("mass")).alias(n) for n in AXES])


def angular_momentum(df: DataFrame, mass: Column, pos: Column, vel: Column, center: Sequence[float], by: Sequence[str | Column] = (), exact: int | None = None) -> DataFrame:
    """Sum of m (r - c) x v. The bulk velocity is not taken off."""
    x, y, z = less(pos, center)
    u, v, w = parts(vel)
    terms = (mass * (y * w - z * v), mass * (z * u - x * w), mass * (x * v - y * u))
    return _by(df, by).agg(*[total(t, exact).alias(n) for n, t in zip(AXES, terms)])


def limits(df: DataFrame, x: Column, positive: bool = False) -> tuple[float, float]:
    """Least and largest value for automatic bins; NaN is left out, and with ``positive`` so is what is not."""
    ok = x.isNotNull() & ~F.isnan(x.cast("double"))
    if positive:
        ok = ok & (x > 0)
    r = df.agg(F.min(F.when(ok, x)).alias("lo"), F.max(F.when(ok, x)).alias("hi")).first()
    return r["lo"], r["hi"]


def top_by(df: DataFrame, column: Column, k: int, tie: Column) -> DataFrame:
    """The k rows with the largest value."""
    return df.orderBy(column.desc(), tie).limit(k)
