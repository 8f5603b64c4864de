"""Slices, stacked slices and ray marches: images that ask which cell is nearest to a point."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .camera import Camera
from .deposit import SPHERE
from .cells import SENT_POINTS, PointTree
from .neighbors import _kept, _matrix, nearest


def cell_radius(volume: Column) -> Column:
    return F.cbrt(volume / F.lit(SPHERE))


def _in_reach(df: DataFrame, camera: Camera, pos: Column, volume: Column, cells: float = 4.0) -> DataFrame:
    """Rows in the camera's box, or outside by at most ``cells`` times their own radius."""
    margin = F.lit(cells) * cell_radius(volume)
    largest = df.agg(F.max(margin).alias("m")).first()["m"]
    return df.filter(camera.region(pos, margin, largest or 0.0))


def slice_image(df: DataFrame, camera: Camera, pos: str, point_id: str, volume: Column, values: Mapping[str, Column], sent_points: int = SENT_POINTS) -> DataFrame:
    """iy, ix and the values of the cell nearest to each pixel's centre. The camera's depth must be zero."""
    if camera.depth != 0:
        raise ValueError("a slice has no depth")
    near = _in_reach(df, camera, F.col(pos), volume)
    points = near.select(F.col(point_id).alias("id"), F.col(pos).alias("pos"), *[v.alias(n) for n, v in values.items()])
    pixels = camera.pixels(df.sparkSession)
    found = nearest(points, pixels, query_id="pixel", sent_points=sent_points)
    out = pixels.join(found, F.col("pixel") == F.col("qid")).join(points.drop("pos"), "id")
    return out.select("iy", "ix", *values)


def stack_image(df: DataFrame, camera: Camera, pos: str, point_id: str, volume: Column, values: Mapping[str, Column], additive: bool = True, npix_depth: int | None = None, tol: float = 1.0, sent_points: int = SENT_POINTS) -> DataFrame:
    """iy, ix and for each value the sum over depth of value / volume times the step (``additive``), else its mean over depth.

    Steps in depth: the depth over the least margin of the rows in reach, divided by ``tol``, unless ``npix_depth`` says how many.
    """
    near = _in_reach(df, camera, F.col(pos), volume)
    if npix_depth is None:
        least = near.agg(F.min(F.lit(4.0) * cell_radius(volume)).alias("m")).first()["m"]
        npix_depth = max(1, math.ceil(camera.depth / least / tol))
    points = near.select(F.col(point_id).alias("id"), F.col(pos).alias("pos"), *[(F.try_divide(v, volume) if additive else v).alias(n) for n, v in values.items()])
    voxels = camera.pixels(df.sparkSession, npix_depth)
    found = nearest(points, voxels, query_id="pixel", sent_points=sent_points)
    all_ = voxels.join(found, F.col("pixel") == F.col("qid")).join(points.drop("pos"), "id")
    step = F.lit(camera.depth / npix_depth)
    return all_.groupBy("iy", "ix").agg(*[(F.sum(n) * step if additive else F.avg(n)).alias(n) for n in values])


def ray_march(df: DataFrame, camera: Camera, pos: str, point_id: str, volume: Column, values: Mapping[str, Column], additive: bool = False, tol: float = 0.25, gas: bool = True, sent_points: int = SENT_POINTS) -> DataFrame:
    """iy, ix and the integral of each value along the pixel's ray, all values in one traversal.

    At each place the nearest cell gives the value and the step: ``tol`` times 1.2 cell diameters for gas, else twice ``tol`` times the
    distance. What the last step goes beyond the depth is taken off. ``additive``: values are divided by the volume; otherwise the integral is
    divided by the depth. Steps are at least a millionth of the depth, and every ray is followed to its end. The nearest cell is found exactly.

    Up to ``sent_points`` points in reach are sent to the tasks. With more, rays and points are dealt to tiles of the image; a tile also gets the points within a margin around it, and a ray that meets a
    cell further away than the margin is followed again with twice the margin.
    """
    spark = df.sparkSession
    names = list(values)
    near = _in_reach(df, camera, F.col(pos), volume).select(F.col(point_id).alias("id"), F.col(pos).alias("pos"), (F.lit(1.2 * 2) * cell_radius(volume)).alias("__h"), *[(F.try_divide(v, volume) if additive else v).cast("double").alias(n) for n, v in values.items()])
    depth, floor = camera.depth, camera.depth * 1e-6
    n = near.count()
    flat = camera.resized(depth=0.0) if camera.depth else camera
    rays = flat.pixels(spark).drop("iz")
    axis = np.asarray(camera._along(2), float)
    if n == 0:
        return rays.select("iy", "ix", *[F.lit(None).cast("double").alias(v) for v in names]).limit(0)
    shape = "iy int, ix int, " + ", ".join(f"`{v}` double" for v in names)
    scale = 1.0 if additive else 1.0 / depth

    def follow(start: np.ndarray, tree: PointTree, sizes: np.ndarray, data: np.ndarray, margin: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Integrals from the given places on, and whether all cells were within the margin."""
        z, total, sure = np.zeros(len(start)), np.zeros((len(start), len(names))), np.ones(len(start), bool)
        live = np.arange(len(start))
        while len(live):
            who, d2 = tree.nearest(start[live] + z[live, None] * axis)
            sure[live[d2 > margin * margin]] = False
            step = np.maximum(tol * sizes[who] if gas else 2 * tol * np.sqrt(d2), floor)
            total[live] += step[:, None] * data[who]
            z[live] += step
            over = np.maximum(z[live] - depth, 0)
            total[live] -= over[:, None] * data[who]
            live = live[(z[live] < depth) & sure[live]]
        return total * scale, sure

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _matrix(t.column("pos").combine_chunks()), t.column("__h").to_numpy(), np.stack([t.column(v).to_numpy() for v in names], 1)

    def begin(where: pa.StructArray) -> np.ndarray:
        return _matrix(where) - axis * depth / 2

    if n <= sent_points:
        points, sizes, data = arrays(near.orderBy("id").toArrow())
        sent = spark.sparkContext.broadcast((PointTree(points), sizes, data))

        def march(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, _ = follow(begin(batch.column("pos")), *sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("iy"), batch.column("ix"), *(pa.array(total[:, k]) for k in range(len(names)))], ["iy", "ix", *names])

        return rays.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, camera.npix_width * camera.npix_height // 64 + 1))).select("iy", "ix", "pos").mapInArrow(march, shape)

    def in_tile(margin: float):
        def tile(rays: pa.Table, points: pa.Table) -> pa.Table:
            total, sure = np.zeros((len(rays), len(names))), np.zeros(len(rays), bool)
            if len(rays) and len(points):
                places, sizes, data = arrays(points.sort_by("id"))
                total, sure = follow(begin(rays.column("pos").combine_chunks()), PointTree(places), sizes, data, margin)
            own = [rays.column(c) for c in ("tx", "ty", "pos")]
            return pa.table([rays.column("iy"), rays.column("ix"), pa.array(sure), *own, pa.array(list(total), pa.list_(pa.float64()))], ["iy", "ix", "sure", "tx", "ty", "pos", "totals"])

        return tile

    # tiles of the image, as many as give an eighth of what may be sent to each on average
    tiles = max(1, math.ceil(math.sqrt(n / max(8, sent_points // 8))))
    across, up = max(1, -(-camera.npix_width // tiles)), max(1, -(-camera.npix_height // tiles))
    wide, high = camera.width * across / camera.npix_width, camera.height * up / camera.npix_height
    u, v, _ = camera.placed(F.col("pos"))
    placed = _kept(near.withColumn("__u", u + F.lit(camera.width / 2)).withColumn("__v", v + F.lit(camera.height / 2)))
    left = rays.withColumn("tx", F.floor(F.col("ix") / across)).withColumn("ty", F.floor(F.col("iy") / up)).select("tx", "ty", "iy", "ix", "pos")
    margin = 2 * (max(camera.width, camera.height, depth) + floor) / n ** (1 / 3)
    last_x, last_y = (camera.npix_width - 1) // across, (camera.npix_height - 1) // up
    done = []
    while True:
        whole = margin >= 2 * (camera.width + camera.height + depth) + 8 * placed.agg(F.max("__h")).first()[0]

        def to(c: str, size: float, last: int) -> Column:
            return F.explode(F.sequence(F.greatest(F.floor((F.col(c) - F.lit(margin)) / F.lit(size)), F.lit(0).cast("long")), F.least(F.floor((F.col(c) + F.lit(margin)) / F.lit(size)), F.lit(last).cast("long"))))

        reached = placed.filter((F.col("__u") >= F.lit(-margin)) & (F.col("__v") >= F.lit(-margin)) & (F.col("__u") < F.lit((last_x + 1) * wide + margin)) & (F.col("__v") < F.lit((last_y + 1) * high + margin)))
        around = reached.withColumn("tx", to("__u", wide, last_x)).withColumn("ty", to("__v", high, last_y)).select("tx", "ty", "id", "pos", "__h", *names)

        made = left.groupBy("tx", "ty").cogroup(around.groupBy("tx", "ty")).applyInArrow(in_tile(np.inf if whole else margin), "iy int, ix int, sure boolean, tx long, ty long, pos struct<x:double,y:double,z:double>, totals array<double>")
        made = _kept(made)
        done.append(made.filter("sure"))
        left = made.filter("NOT sure").select("tx", "ty", "iy", "ix", "pos")
        if whole or not left.take(1):
            break
        margin *= 2
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("iy", "ix", *[F.col("totals")[k].alias(v) for k, v in enumerate(names)])
