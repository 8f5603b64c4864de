"""Shards of near-equal bytes from a k-d tree over document metadata, in DataFrame operations only.

A node that is due k shards is split at the weighted median (the k//2 in k quantile of bytes) along its widest dimension.
Medians are found by repeated histograms: one aggregation over all open nodes, then the cell that holds the quantile is looked at more closely. Nodes' cells and their cuts are tables of their own, which
meet the rows in joins; the driver holds none of them, however many shards there are. Texts are read once, for size and checksum; after that only metadata move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import cut, shuffle_width

#: Histogram cells of a node.
CELLS = 1 << 12
DEFAULT_DIMS = ("source", "lang", "n_chars", "doc_id")
COORD_BITS, TIE_BITS = 30, 32
#: A split this close to its quantile, as a share of one shard's bytes, is not refined.
TOLERANCE = 1e-4
ROWS_A_RUN = 100_000
#: Nodes whose table is sent to all tasks (some 60 bytes each); the tables of more are joined as adaptive execution sees fit.
SENT_NODES = 50_000
#: Levels of the tree after which the rows are written out with their nodes.
LEVELS_A_CUT = 2


def _number(docs: DataFrame, name: str, skip: int = 0) -> Column:
    """A finite double for any simple column: numbers as they are, lengths by their logarithm, strings by six bytes after the ``skip`` that all share; none is the least."""
    kind = dict(docs.dtypes)[name]
    col = F.col(f"`{name}`")
    if kind == "string":
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1 + skip, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))
    if kind in ("timestamp", "date", "timestamp_ntz"):
        return F.coalesce(F.unix_micros(col.cast("timestamp")).cast("double"), F.lit(-1.0))
    value = col.cast("double")
    if name in ("n_chars", "size"):
        value = F.log1p(F.greatest(value, F.lit(0.0)))
    return F.coalesce(F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value), F.lit(-1.0))


def _shared_bytes(docs: DataFrame, names: list[str]) -> dict[str, int]:
    """UTF-8 bytes in which all values of each string column begin alike: those of the least and the greatest."""
    if not names:
        return {}
    ends = docs.agg(*[f(F.encode(F.substring(F.col(f"`{n}`"), 1, 256), "UTF-8")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for i, n in enumerate(names):
        low, high = bytes(ends[f"lo{i}"] or b""), bytes(ends[f"hi{i}"] or b"")
        out[n] = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    return out


def metadata(docs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, tie and coordinates c0.. in 30 bits, written out once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    skip = _shared_bytes(docs, [d for d in dims if dict(docs.dtypes)[d] == "string"])
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[_number(docs, d, skip.get(d, 0)).alias(f"v{i}") for i, d in enumerate(dims)],
    )
    raw = cut(raw.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - TIE_BITS)))
    if not dims:
        return raw.withColumn("root", F.lit(0).cast("long"))
    ends = raw.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i in range(len(dims)):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        scale = ((1 << COORD_BITS) - 1) / (hi - lo) if lo is not None and hi > lo else 0.0
        out.append(F.floor((F.col(f"v{i}") - F.lit(lo or 0.0)) * F.lit(scale)).cast("long").alias(f"c{i}"))
    return raw.select("doc_id", "size", "text_crc32", "tie", F.lit(0).cast("long").alias("root"), *out)


def _place(dims: int) -> Column:
    """The node's coordinate along its own dimension, ties apart by a hash."""
    by = F.lit(0).cast("long")
    for i in range(dims):
        by = F.when(F.col("dim") == i, F.col(f"c{i}")).otherwise(by)
    return by * F.lit(1 << TIE_BITS) + F.col("tie")


def _spans(rows: DataFrame, dims: int) -> DataFrame:
    """For each node that is due more than one shard: its widest dimension, the range of places there (lo to hi), the bytes below the range, and the bytes that the lower side is due."""
    ends = [f(f"c{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = rows.filter("k > 1").groupBy("first", "k").agg(F.sum("size").alias("w"), *ends)
    dim, low, high = F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")
    if dims:
        width = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(dims)]
        most = F.greatest(*width) if dims > 1 else width[0]
        dim = F.coalesce(*[F.when(width[i] == most, F.lit(i)) for i in range(dims)])
        low, high = (F.element_at(F.array(*[F.col(f"{n}{i}") for i in range(dims)]), F.col("dim") + 1) for n in ("lo", "hi"))
    half = F.floor(F.col("k") / 2)
    return stats.withColumn("dim", dim).select("first", "dim", (low * F.lit(1 << TIE_BITS)).alias("lo"), ((high + 1) * F.lit(1 << TIE_BITS) - 1).alias("hi"), F.lit(0).cast("long").alias("below"), (F.col("w") * half / F.col("k")).alias("target"))


def _few(table: DataFrame, n: int) -> DataFrame:
    """``table`` has n rows at most."""
    return F.broadcast(table) if n <= SENT_NODES else table


def _cuts(rows: DataFrame, spans: DataFrame, dims: int, slack: float, n: int) -> DataFrame:
    """first, dim and at: rows of the node whose place is below ``at`` go to its lower side. ``n``: nodes at most."""
    from pyspark.sql import Window

    open_, done = spans, []
    while open_.take(1):
        width = F.greatest(F.floor((F.col("hi") - F.col("lo")) / CELLS) + 1, F.lit(1)).cast("long")
        near = rows.join(_few(open_.withColumn("width", width), n), "first").withColumn("x", _place(dims)).filter("x BETWEEN lo AND hi")
        same = [F.max(c).alias(c) for c in ("dim", "below", "target")]
        cells = near.groupBy("first", F.expr("(x - lo) div width").alias("cell")).agg(F.sum("size").alias("w"), F.min("x").alias("a"), F.max("x").alias("b"), *same)
        upto = cells.withColumn("end", F.col("below") + F.sum("w").over(Window.partitionBy("first").orderBy("a")))
        # the first cell that reaches the quantile; its nearer end, if that is near enough or the cell is one place
        reached = upto.filter("end >= target").groupBy("first").agg(F.min(F.struct("a", "b", "w", "end", "target", "dim")).alias("m")).select("first", "m.*")
        before = F.col("end") - F.col("w")
        best = F.least(F.struct(F.abs(F.col("target") - before).alias("off"), F.col("a").alias("at")), F.struct(F.abs(F.col("end") - F.col("target")).alias("off"), (F.col("b") + 1).alias("at")))
        found = cut(reached.withColumn("best", best).withColumn("below", before))
        enough = (F.col("a") == F.col("b")) | (F.col("best.off") <= F.lit(slack))
        done.append(found.filter(enough).select("first", "dim", F.col("best.at").alias("at")))
        open_ = found.filter(~enough).select("first", "dim", F.col("a").alias("lo"), F.col("b").alias("hi"), "below", "target")
    out = done[0] if done else spans.select("first", "dim", F.col("lo").alias("at")).limit(0)
    for more in done[1:]:
        out = out.union(more)
    return out


def assign(meta: DataFrame, dims: int, shards: int, total: int) -> DataFrame:
    """``meta`` with a column shard from 0 to shards - 1. ``total``: bytes of all rows.

    A node is known by the first of the shards that it is due.
    """
    rows = meta.withColumnRenamed("root", "first").withColumn("k", F.lit(shards).cast("long"))
    level, most = 0, shards
    while most > 1:
        # the tree has 2^level nodes by now, and no more than shards
        n = min(shards, 1 << level)
        cuts = _cuts(rows, cut(_spans(rows, dims)), dims, TOLERANCE * total / shards, n)
        half = F.floor(F.col("k") / 2)
        low = F.when(F.col("at").isNotNull(), _place(dims) < F.col("at"))
        placed = rows.join(_few(cuts, n), "first", "left").withColumn("__low", low)
        first = F.when(F.col("__low").isNull() | F.col("__low"), F.col("first")).otherwise(F.col("first") + half)
        k = F.when(F.col("__low").isNull(), F.col("k")).when(F.col("__low"), half).otherwise(F.col("k") - half)
        rows = placed.withColumns({"first": first, "k": k}).drop("dim", "at", "__low")
        level, most = level + 1, most - most // 2
        if level % LEVELS_A_CUT == 0:
            rows = cut(rows)
    return rows.withColumn("shard", F.col("first").cast("int")).drop("first", "k")


def with_slots(rows: DataFrame, shards: int, n_rows: int) -> DataFrame:
    """A gapless slot from 0 in each shard: counts of hash-dealt runs give each run its first slot, so that no shard is sorted in one task."""
    from pyspark.sql import Window

    runs = max(math.ceil(n_rows / max(1, shards) / ROWS_A_RUN), math.ceil(4 * shuffle_width(rows.sparkSession) / max(1, shards)), 1)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("tie", "text_crc32", "size"), F.lit(runs)))
    first = rows.groupBy("shard", "run").count().withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("run")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("own", own).join(first, ["shard", "run"]).withColumn("slot", (F.col("first") + F.col("own")).cast("long")).drop("own", "first", "run")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DEFAULT_DIMS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row.

    Give the number of ``shards`` or the ``target_bytes`` of one. ``dims`` that ``docs`` lacks are left out. Law: bytes, that is
    all shards have near-equal sums of size, up to the largest row. A null text has no bytes; null, NaN and infinite metadata sort first. Rows
    that agree in doc_id, text and all dims can't be told apart and share a shard. Extra columns are ignored; an empty table gives an empty result.
    """
    dims = tuple(d for d in dims if d in docs.columns)
    meta = cut(metadata(docs, dims))
    total = meta.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).first()
    if shards is None:
        shards = max(1, math.ceil((total["w"] or 0) / target_bytes))
    placed = assign(meta, len(dims), shards, total["w"]) if total["n"] else meta.withColumn("shard", F.lit(0))
    return with_slots(placed.select("doc_id", "size", "text_crc32", "tie", "shard"), shards, total["n"]).select("doc_id", "size", "text_crc32", "shard", "slot")
