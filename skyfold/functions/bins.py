"""Bin edges and bin numbers as expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def make_edges(lo: float, hi: float, n: int, log: bool = False) -> np.ndarray:
    """n + 1 edges, equal in width or in log10."""
    if log and lo <= 0:
        raise ValueError("logarithmic bins need positive limits")
    return np.logspace(np.log10(lo), np.log10(hi), n + 1) if log else np.linspace(lo, hi, n + 1)


def centers(edges: Sequence[float], log: bool = False) -> np.ndarray:
    """Middles, geometric for logarithmic bins."""
    e = np.asarray(edges, float)
    return np.sqrt(e[1:] * e[:-1]) if log else 0.5 * (e[1:] + e[:-1])


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin [e_i, e_i+1) that holds x; null below, from the last edge up, and for NaN and null. A search tree of comparisons, without arrays."""
    edges = [float(e) for e in edges]

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(edges[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= F.lit(edges[0])) & (x < F.lit(edges[-1])), search(0, len(edges) - 1))


def even_bin(x: Column, lo: float, hi: float, n: int, log: bool = False) -> Column:
    """Number by arithmetic, (x - lo) n / (hi - lo) cut to an integer, in log10 where asked for; null outside and at hi."""
    if log:
        a, b = float(np.log10(lo)), float(np.log10(hi))
        place = (F.log10(x) - F.lit(a)) * F.lit(float(n)) / F.lit(b - a)
    else:
        place = (x - F.lit(float(lo))) * F.lit(float(n)) / F.lit(float(hi) - float(lo))
    inside = x.isNotNull() & ~F.isnan(x) & (x >= F.lit(float(lo))) & (x <= F.lit(float(hi)))
    index = F.when(inside, F.floor(place).cast("int"))
    return F.when((index >= 0) & (index < n), index)


def spine(spark: SparkSession, edges: Sequence[float], log: bool = False) -> DataFrame:
    """One row for each bin: bin, lo, hi, center."""
    e = [float(x) for x in edges]
    rows = list(zip(range(len(e) - 1), e[:-1], e[1:], centers(e, log).tolist()))
    body = ", ".join(f"({i}, {a!r}D, {b!r}D, {c!r}D)" for i, a, b, c in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t(bin, lo, hi, center)")
