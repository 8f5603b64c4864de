"""Nearest neighbours and radius search as equi-joins on grid cells, and Morton keys.

Points and queries meet on integer cell numbers; a query looks into the 27 cells around its own. A match no further than the cell's width is
proven to be the nearest. Queries without one go on with cells twice as wide. No cross join. A set of points of a checked size is sent to the queries' tasks as a kd-tree instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import AXES, parts
from ..shared import shared_folder
from .cells import SENT_POINTS, PointTree

MORTON_BITS = 21
CROWD = 512


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration in the folder that the session shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width))


def _cells(df: DataFrame, pos: str, width: float, around: bool) -> DataFrame:
    cells = [_cell(c, width) for c in parts(F.col(pos))]
    if not around:
        return df.select("*", *[c.alias(f"c{n}") for n, c in zip(AXES, cells)])
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{n}") for n, s in zip(AXES, d)]) for d in product((-1, 0, 1), repeat=3)])
    out = df.withColumn("__d", F.explode(steps))
    return out.select(*df.columns, *[(c + F.col(f"__d.d{n}")).alias(f"c{n}") for n, c in zip(AXES, cells)])


def _distance2() -> Column:
    d = [F.col(f"__q.{n}") - F.col(f"__p.{n}") for n in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _extent(points: DataFrame, pos: Column) -> tuple[int, float]:
    """Rows, and the widest side of their bounding box."""
    r = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{n}") for n, c in zip(AXES, parts(pos)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return r["n"], max(r[f"hi{n}"] - r[f"lo{n}"] for n in AXES) if r["n"] else 0.0


def nearest(points: DataFrame, queries: DataFrame, pos: str = "pos", point_id: str = "id", query_id: str = "qid", ignore_self: bool = False, width: float | None = None, sent_points: int = SENT_POINTS) -> DataFrame:
    """The nearest point of each query: qid, id and d2 (squared distance); ties go to the smaller id.

    ``ignore_self``: leave points at distance zero out. Queries without any point left are not in the result. Up to ``sent_points`` points
    are sent to the queries' tasks as one tree; with more, points and queries meet in joins on cells.
    """
    # points at one place differ by their ids only: the smallest stands for all, however many there are
    p = points.groupBy(F.col(pos).alias("__p")).agg(F.min(point_id).alias("id")).select("id", "__p")
    left = queries.select(F.col(query_id).alias("qid"), F.col(pos).alias("__q"))
    n, side = _extent(p, F.col("__p"))
    if not n:
        return left.select("qid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("d2")).limit(0)
    if n <= sent_points:
        return _nearest_sent(p, left, ignore_self)
    _, q_side = _extent(left, F.col("__q"))
    width = width or _first_width(p, side, n)
    span = max(side, q_side, width)
    found = []
    while True:
        near = _cells(p, "__p", width, False).join(_cells(left, "__q", width, True), ["cx", "cy", "cz"]).withColumn("d2", _distance2())
        if ignore_self:
            near = near.filter("d2 > 0")
        best = near.groupBy("qid").agg(F.min(F.struct("d2", "id")).alias("b")).select("qid", F.col("b.id").alias("id"), F.col("b.d2").alias("d2"))
        # a neighbour outside the 27 cells is further than one width away
        done = _kept(best.filter(F.col("d2") <= F.lit(width * width)))
        found.append(done)
        left = _kept(left.join(done.select("qid"), "qid", "left_anti"))
        if not left.take(1):
            break
        if width > 4 * span:
            gap = _gap(p, left)
            if gap <= width:
                break
            width = gap
        else:
            width *= 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _sent(p: DataFrame):
    """Ids and the tree of points (id, __p), of which there are as many as may be sent."""
    table = p.orderBy("id").toArrow()
    return p.sparkSession.sparkContext.broadcast((table.column("id").combine_chunks(), PointTree(_matrix(table.column("__p").combine_chunks()))))


def _nearest_sent(p: DataFrame, queries: DataFrame, ignore_self: bool) -> DataFrame:
    sent = _sent(p)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tree = sent.value
        for batch in batches:
            if batch.num_rows:
                who, d2 = tree.nearest(_matrix(batch.column(1)), ignore_self)
                ok = np.flatnonzero(who >= 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), ids.take(pa.array(who[ok])), pa.array(d2[ok])], ["qid", "id", "d2"])

    kinds = {**dict(queries.dtypes), **dict(p.dtypes)}
    return queries.select("qid", "__q").mapInArrow(look, f"qid {kinds['qid']}, id {kinds['id']}, d2 double")


def _matrix(places: pa.StructArray) -> np.ndarray:
    return np.stack([places.field(k).to_numpy(zero_copy_only=False) for k in range(3)], 1).astype(np.float64)


def _first_width(p: DataFrame, side: float, n: int) -> float:
    """The mean spacing, halved while a cell holds over ``CROWD`` points: queries in a dense place are done in small cells, and few are left when cells get wide."""
    width = side / n ** (1 / 3) or 1.0
    for _ in range(20):
        cells = [_cell(c, width).alias(f"c{k}") for k, c in zip(AXES, parts(F.col("__p")))]
        if p.groupBy(*cells).count().agg(F.max("count")).first()[0] <= CROWD:
            break
        width /= 2
    return width


def _gap(p: DataFrame, q: DataFrame) -> float:
    """Largest distance that any query can have to any point, by their bounding boxes."""
    ends = [df.agg(*[f(F.col(f"{c}.{n}")).alias(f"{k}{n}") for n in AXES for k, f in (("lo", F.min), ("hi", F.max))]).first() for df, c in ((p, "__p"), (q, "__q"))]
    return float(np.sqrt(sum(max(ends[0][f"hi{n}"] - ends[1][f"lo{n}"], ends[1][f"hi{n}"] - ends[0][f"lo{n}"]) ** 2 for n in AXES)) * 1.001)


def within(points: DataFrame, queries: DataFrame, radius: float, pos: str = "pos", point_id: str = "id", query_id: str = "qid", most: int | None = None, sent_points: int = SENT_POINTS) -> DataFrame:
    """All points no further than ``radius`` from each query: qid, id, d2. ``most``: only so many nearest of each query, ties to the smaller id; column n_all has the full count.

    Up to ``sent_points`` points are sent to the queries' tasks as one tree, where a query's matches are counted and cut before they leave. With more, points and queries meet on cells as wide as the
    radius; a cell of over ``CROWD`` points is dealt over portions, to each of which the queries around it are copied, so that no task holds a whole crowd, and each portion keeps ``most`` matches of a query at most.
    """
    p = points.select(F.col(point_id).alias("id"), F.col(pos).alias("__p"))
    q = queries.select(F.col(query_id).alias("qid"), F.col(pos).alias("__q"))
    if p.limit(sent_points + 1).count() <= sent_points:
        return _within_sent(p, q, radius, most)
    cells = ["cx", "cy", "cz"]
    placed = _cells(p, "__p", radius, False)
    crowds = _kept(placed.groupBy(*cells).count().filter(F.col("count") > CROWD).select(*cells, F.ceil(F.col("count") / CROWD).alias("portions")))
    dealt = placed.join(crowds, cells, "left").withColumn("portion", F.coalesce(F.pmod(F.xxhash64("id", "__p"), F.col("portions")), F.lit(0).cast("long"))).drop("portions")
    asked = _cells(q, "__q", radius, True).join(crowds, cells, "left").withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("portions", F.lit(1).cast("long")) - 1))).drop("portions")
    near = dealt.join(asked, [*cells, "portion"])
    out = near.select("qid", "id", _distance2().alias("d2"), *cells, "portion").filter(F.col("d2") <= F.lit(radius * radius))
    if most is None:
        return out.select("qid", "id", "d2")
    own = Window.partitionBy("qid", *cells, "portion")
    first = out.withColumn("__n", F.count(F.lit(1)).over(own)).withColumn("__r", F.row_number().over(own.orderBy("d2", "id"))).filter(F.col("__r") <= most)
    each = Window.partitionBy("qid")
    ranked = first.withColumn("n_all", F.sum(F.when(F.col("__r") == 1, F.col("__n")).otherwise(0)).over(each)).withColumn("__s", F.row_number().over(each.orderBy("d2", "id")))
    return ranked.filter(F.col("__s") <= most).select("qid", "id", "d2", "n_all")


def _within_sent(p: DataFrame, q: DataFrame, radius: float, most: int | None) -> DataFrame:
    kinds = {**dict(q.dtypes), **dict(p.dtypes)}
    shape = f"qid {kinds['qid']}, id {kinds['id']}, d2 double" + (", n_all long" if most is not None else "")
    if not p.take(1):
        return p.sparkSession.createDataFrame([], shape)
    sent = _sent(p)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tree = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            for who, index, d2 in tree.within(_matrix(batch.column(1)), radius):
                order = np.lexsort((index, d2, who))
                who, index, d2 = who[order], index[order], d2[order]
                more = []
                if most is not None:
                    first = np.searchsorted(who, who)
                    n_all = np.searchsorted(who, who, "right") - first
                    keep = np.arange(len(who)) - first < most
                    who, index, d2, more = who[keep], index[keep], d2[keep], [pa.array(n_all[keep])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), ids.take(pa.array(index)), pa.array(d2), *more], ["qid", "id", "d2", *["n_all"] * len(more)])

    return q.mapInArrow(look, shape)


def nearest_holding(points: DataFrame, queries: DataFrame, half: Column, pos: str = "pos", point_id: str = "id", query_id: str = "qid") -> DataFrame:
    """The nearest of the points whose box, ``half`` wide to each side of the point, holds the query: qid, id and d2, null where no box does. Boxes are closed; ties go to the smaller id.

    Boxes and queries meet on cells of the power of two next above a box's width, of which a box touches eight at most.
    """
    p = points.select(F.col(point_id).alias("id"), F.col(pos).alias("__p"), F.greatest(half.cast("double"), F.lit(1e-12)).alias("__h"))
    p = _kept(p.withColumn("level", F.ceil(F.log2(F.col("__h") * 2.0)).cast("int")))
    q = queries.select(F.col(query_id).alias("qid"), F.col(pos).alias("__q"))
    levels = [r["level"] for r in p.select("level").distinct().collect()]  # exponents of two: some tens at most
    if not levels:
        return q.select("qid", F.lit(None).cast(dict(p.dtypes)["id"]).alias("id"), F.lit(None).cast("double").alias("d2"))
    width = F.pow(F.lit(2.0), F.col("level").cast("double"))
    for n in AXES:
        middle = F.col(f"__p.{n}")
        p = p.withColumn(f"c{n}", F.explode(F.sequence(F.floor((middle - F.col("__h")) / width), F.floor((middle + F.col("__h")) / width))))
    asked = q.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    asked = asked.select("*", *[F.floor(F.col(f"__q.{n}") / width).alias(f"c{n}") for n in AXES])
    near = p.join(asked, ["level", "cx", "cy", "cz"])
    for n in AXES:
        near = near.filter((F.col(f"__q.{n}") >= F.col(f"__p.{n}") - F.col("__h")) & (F.col(f"__q.{n}") <= F.col(f"__p.{n}") + F.col("__h")))
    best = near.groupBy("qid").agg(F.min(F.struct(_distance2().alias("d2"), "id")).alias("b"))
    return q.select("qid").join(best, "qid", "left").select("qid", F.col("b.id").alias("id"), F.col("b.d2").alias("d2"))


def spread_bits(c: Column) -> Column:
    """Two zero bits between the lowest 21 bits."""
    x = c.cast("long").bitwiseAND(F.lit((1 << MORTON_BITS) - 1))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def gather_bits(c: Column) -> Column:
    """Every third bit, from the lowest."""
    x = c.bitwiseAND(F.lit(0x1249249249249249))
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton_key(ix: Column, iy: Column, iz: Column) -> Column:
    """63 bits of three 21-bit integers, x highest in each triple."""
    return F.shiftleft(spread_bits(ix), 2).bitwiseOR(F.shiftleft(spread_bits(iy), 1)).bitwiseOR(spread_bits(iz))


def morton_decode(key: Column) -> tuple[Column, Column, Column]:
    return gather_bits(F.shiftright(key, 2)), gather_bits(F.shiftright(key, 1)), gather_bits(key)


def scaled_cells(df: DataFrame, pos: Column) -> list[Column]:
    """Coordinates as integers from 0 to 2^21 - 1: each axis from its own minimum, all by one factor."""
    r = df.agg(*[f(c).alias(f"{k}{n}") for n, c in zip(AXES, parts(pos)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    side = max(r[f"hi{n}"] - r[f"lo{n}"] for n in AXES) or 1.0
    top = float((1 << MORTON_BITS) - 1)
    return [F.floor((c - F.lit(r[f"lo{n}"])) / F.lit(side) * F.lit(top)).cast("long") for n, c in zip(AXES, parts(pos))]


def clustered(df: DataFrame, pos: str, partitions: int) -> DataFrame:
    """Rows dealt by ranges of their Morton key and sorted by it, for locality on disk."""
    key = morton_key(*scaled_cells(df, F.col(pos)))
    return df.withColumn("morton", key).repartitionByRange(partitions, "morton").sortWithinPartitions("morton")
