"""Vector arithmetic on struct columns; every sum is written in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
GRADIENT = tuple(f"g{i}{j}" for i in range(3) for j in range(3))


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def parts(v: Column) -> tuple[Column, Column, Column]:
    return v["x"], v["y"], v["z"]


def dot(u, v) -> Column:
    (a, b, c), (p, q, r) = u, v
    return a * p + b * q + c * r


def square(v: Column) -> Column:
    x, y, z = parts(v)
    return x * x + y * y + z * z


def less(v: Column, center) -> tuple[Column, Column, Column]:
    """Components of v - center."""
    return tuple(c - F.lit(float(m)) for c, m in zip(parts(v), center))


def curl(g: Column) -> tuple[Column, Column, Column]:
    """Of a field whose gradient is ``g`` (g_ij: derivative of component i along j)."""
    return g["g21"] - g["g12"], g["g02"] - g["g20"], g["g10"] - g["g01"]


def curvature(b: Column, g: Column) -> Column:
    """Length of (G b) / b^2 - b (b G b) / b^4; null where b is zero. Without a CASE around it, so that common parts are computed once."""
    b = parts(b)
    along = [dot((g[f"g{k}0"], g[f"g{k}1"], g[f"g{k}2"]), b) for k in range(3)]
    size = dot(b, b)
    both = dot(b, along)
    out = [F.try_divide(along[k], size) - F.try_divide(b[k] * both, size * size) for k in range(3)]
    return F.sqrt(dot(out, out))
