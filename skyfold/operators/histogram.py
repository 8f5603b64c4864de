"""Weighted histograms in one and two dimensions: each row is put into its bin once, all weights are summed in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import edge_bin, even_bin, make_edges, spine
from .aggregates import limits, total


def histogram1d(df: DataFrame, x: Column, edges: Sequence[float] | int, weights: Mapping[str, Column], log: bool = False, normalize: bool = False, exact: int | None = None) -> DataFrame:
    """bin, lo, hi, center and one sum for each weight; empty bins are zero.

    Bins are [lo, hi): values at or beyond the last edge are left out, so that with a number of bins, whose limits are the data's own, the largest value is too. ``normalize``: sums divided by their total times
    the bin's width, in dex for ``log``.
    """
    if isinstance(edges, int):
        lo, hi = limits(df, x, positive=log)
        edges = make_edges(lo, hi, edges, log)
    sums = df.select(edge_bin(x, edges).alias("bin"), *[w.alias(n) for n, w in weights.items()]).filter("bin IS NOT NULL")
    sums = sums.groupBy("bin").agg(*[total(F.col(n), exact).alias(n) for n in weights])
    out = spine(df.sparkSession, edges, log).join(sums, "bin", "left")
    out = out.select("bin", "lo", "hi", "center", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in weights])
    if normalize:
        width = F.log10("hi") - F.log10("lo") if log else F.col("hi") - F.col("lo")
        whole = Window.partitionBy(F.lit(0))  # one row for each bin
        out = out.select("bin", "lo", "hi", "center", *[(F.try_divide(F.col(n), F.sum(n).over(whole)) / width).alias(n) for n in weights])
    return out


def profile(df: DataFrame, x: Column, edges: Sequence[float], weight: Column, values: Mapping[str, Column], log: bool = False, exact: int | None = None) -> DataFrame:
    """Weighted mean of each value in each bin, with the weight's sum; null where there is no weight."""
    sums = histogram1d(df, x, edges, {"weight": weight} | {n: weight * v for n, v in values.items()}, log, exact=exact)
    return sums.select("bin", "lo", "hi", "center", "weight", *[F.try_divide(F.col(n), F.col("weight")).alias(n) for n in values])


def with_shell_volume(hist: DataFrame) -> DataFrame:
    """Adds the volume between the spheres of radius lo and hi."""
    return hist.withColumn("volume", F.lit(4 * np.pi / 3) * (F.col("hi") * F.col("hi") * F.col("hi") - F.col("lo") * F.col("lo") * F.col("lo")))


def histogram2d(df: DataFrame, x: Column, y: Column, limits_x: tuple[float, float], limits_y: tuple[float, float], n_x: int, n_y: int, weight: Column | None = None, log: bool = False, normalize: bool = False, exact: int | None = None) -> DataFrame:
    """iy, ix and value of the bins that hold rows; bins by arithmetic. ``normalize``: values times bin area sum to one, areas in dex^2 for ``log``.

    A lower limit that is not positive is not allowed with ``log``.
    """
    if log and (limits_x[0] <= 0 or limits_y[0] <= 0):
        raise ValueError("logarithmic bins need positive limits")
    binned = df.select(even_bin(y, *limits_y, n_y, log).alias("iy"), even_bin(x, *limits_x, n_x, log).alias("ix"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    out = binned.filter("iy IS NOT NULL AND ix IS NOT NULL").groupBy("iy", "ix").agg(total(F.col("w"), exact).alias("value"))
    if normalize:
        # the sum over all bins comes from an aggregation of its own, not from a window in one task
        area = np.prod([(np.log10(b) - np.log10(a) if log else b - a) / n for (a, b), n in ((limits_x, n_x), (limits_y, n_y))])
        whole = out.agg(total(F.col("value"), exact).alias("whole"))
        out = out.crossJoin(F.broadcast(whole)).select("iy", "ix", (F.col("value") / (F.col("whole") * F.lit(float(area)))).alias("value"))
    return out


def color_label(x: str, y: str, weight: str | None = None, normalize: bool = True, log: bool = True) -> str:
    """Text for a colour bar of a two-dimensional histogram."""
    top = f"\\mathrm{{d}}^2 {weight}" if weight else "\\mathrm{d}^2 N"
    axes = [f"\\mathrm{{d}}\\log_{{10}}({s})" if log else f"\\mathrm{{d}}{s}" for s in (x, y)]
    scale = f"{weight or 'N'}_\\mathrm{{tot}}^{{-1}}\\," if normalize else ""
    return f"${scale}{top} / {axes[0]}\\,{axes[1]}$"
