"""Histograms and sums over streams of rows: the batch expressions on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import edge_bin
from ..operators.aggregates import total


def live_histogram(stream: DataFrame, x: Column, edges: Sequence[float], weights: Mapping[str, Column], time: str | None = None, window: str | None = None, late: str = "10 minutes", exact: int | None = None) -> DataFrame:
    """Bin sums of a stream (output mode complete or update), over all of it or by windows of event time; rows later than the watermark are left out.

    State is one row for each bin (and window); empty bins are not emitted.
    """
    binned = stream.withColumn("bin", edge_bin(x, edges)).filter("bin IS NOT NULL")
    keys: list = ["bin"]
    if time is not None:
        binned = binned.withWatermark(time, late)
        keys = [F.window(time, window or "1 hour").alias("window"), "bin"]
    return binned.groupBy(*keys).agg(*[total(w, exact).alias(n) for n, w in weights.items()])
