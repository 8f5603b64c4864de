"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has a smaller one in its component, with the component's smallest node.

    ``edges``: long columns u and v. A node's edges are never gathered in one task: minima are partial aggregates and
    the steps are joins, which adaptive execution splits on a hub. Each round is cut by a checkpoint.
    """
    edges = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, cut(small.distinct())
        release(before)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return got["n"], got["h"]
