"""Images by kernel deposition.

Each row spreads its value over the pixels that its kernel 1 - r^2 / h^2 reaches. Partitions add up what they deposit and emit one row for
each pixel they touched; a shuffle adds those. Large images are handled sparsely, so that a partition's memory is bounded by the pixels it touches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .camera import Camera

SPHERE = 4 * math.pi / 3
#: Pixels up to which a partition adds into a dense array.
DENSE = 1 << 22
#: Stencil entries that are worked on at once.
SLAB = 1 << 20
MICRO = 1e6


def kernel_size(volume: Column, nvol: float = 8) -> Column:
    """Radius of the sphere of ``nvol`` times the cell's volume."""
    return F.cbrt(F.lit(float(nvol)) * volume / F.lit(SPHERE))


def _norms(share: np.ndarray) -> np.ndarray:
    """Sums over each kernel's pixels, rounded once, so that no order of summation decides where a deposit lies half way between two millionths.

    Shares (1 - q, or 0) are whole multiples of 2^-53 and up to ``SLAB`` of them meet here: what is above and what is below 2^-27 add up without rounding.
    """
    high = np.floor(share * 2.0**27) * 2.0**-27
    return high.sum(axis=(1, 2)) + (share - high).sum(axis=(1, 2))


def _stencils(x, y, h, value, nx, ny) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flat pixel numbers and shares of the value, for kernels in pixel units; edge mass is lost, not moved.

    Entries are worked on ``SLAB`` at a time; of a kernel that is larger than that, some rows of pixels at a time, for its norm first and then for those in the image.
    """
    h = np.maximum(h, 1.0)
    reach = h.astype(np.int64) + 1
    px, py = np.trunc(x).astype(np.int64), np.trunc(y).astype(np.int64)
    small = 4 * reach * reach <= SLAB
    for r in np.unique(reach[small]):
        who = np.flatnonzero(reach == r)
        step = np.arange(-r, r)
        size = max(1, SLAB // (4 * r * r))
        for a in range(0, len(who), size):
            w = who[a : a + size]
            ix, iy = px[w, None] + step, py[w, None] + step
            dx, dy = x[w, None] - (ix + 0.5), y[w, None] - (iy + 0.5)
            share = 1.0 - (dx[:, :, None] ** 2 + dy[:, None, :] ** 2) / (h[w] * h[w])[:, None, None]
            np.maximum(share, 0.0, out=share)
            norm = _norms(share)
            # a kernel that meets no pixel centre puts all into its own pixel
            none = norm <= 0
            share[none, r, r], norm[none] = 1.0, 1.0
            flat = np.where((ix >= 0) & (ix < nx), ix, -1)[:, :, None] + np.zeros_like(iy)[:, None, :]
            row = np.where((iy >= 0) & (iy < ny), iy, -1)[:, None, :]
            ok = (share > 0) & (flat >= 0) & (row >= 0)
            yield (row * nx + flat)[ok], (share * (value[w] / norm)[:, None, None])[ok]
    for i in np.flatnonzero(~small):
        yield from _wide_stencil(x[i], y[i], h[i], value[i], nx, ny)


def _wide_stencil(x: float, y: float, h: float, value: float, nx: int, ny: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A single kernel of many pixels. Its norm is summed over its columns of pixels in closed form: in each, the pixels it reaches are a run, over which the share is a polynomial of second degree."""
    r = int(h) + 1
    ix = math.trunc(x) + np.arange(-r, r)
    dx = x - (ix + 0.5)
    left = np.maximum(1.0 - dx * dx / (h * h), 0.0)
    half = h * np.sqrt(left)
    first, last = np.maximum(np.ceil(y - half - 0.5), math.trunc(y) - r), np.minimum(np.floor(y + half - 0.5), math.trunc(y) + r - 1)
    n = np.maximum(last - first + 1, 0)
    # sums of k and k^2 over the run, k from its first pixel's distance on
    d = first + 0.5 - y
    squares = n * d * d + d * n * (n - 1) + (n - 1) * n * (2 * n - 1) / 6
    norm = float((n * left - squares / (h * h)).sum())
    near = np.flatnonzero((ix >= 0) & (ix < nx) & (left > 0))
    low, high = max(0, math.trunc(y) - r), min(ny, math.trunc(y) + r)
    step = max(1, SLAB // max(1, len(near)))
    for a in range(low, high, step):
        iy = np.arange(a, min(high, a + step))
        dy = y - (iy + 0.5)
        share = left[near][None, :] - (dy * dy / (h * h))[:, None]
        row, col = np.nonzero(share > 0)
        yield iy[row] * nx + ix[near][col], share[row, col] * (value / norm)


def _deposit(batches: Iterator[pa.RecordBatch], sizes: dict[int, tuple[int, int]], micro: bool) -> Iterator[pa.RecordBatch]:
    """Sums by level and pixel. Columns: level, x, y, h (pixel units of the level), value."""
    dense = {k: np.zeros(nx * ny, np.int64 if micro else float) for k, (nx, ny) in sizes.items() if nx * ny <= DENSE}
    touched = {k: np.zeros(len(v), bool) for k, v in dense.items()}

    def rows(level: int, flat: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        nx = sizes[level][0]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), level, np.int32)), pa.array((flat // nx).astype(np.int32)), pa.array((flat % nx).astype(np.int32)), pa.array(value)], ["level", "iy", "ix", "value"])

    for batch in batches:
        level, x, y, h, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        for k in np.unique(level):
            mine = level == k
            nx, ny = sizes[int(k)]
            for flat, share in _stencils(x[mine], y[mine], h[mine], value[mine], nx, ny):
                add = np.floor(share * MICRO + 0.5).astype(np.int64) if micro else share
                if int(k) in dense:
                    np.add.at(dense[int(k)], flat, add)
                    touched[int(k)][flat] = True
                elif len(flat):
                    order = np.argsort(flat, kind="stable")
                    flat, add = flat[order], add[order]
                    at = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
                    yield rows(int(k), flat[at], np.add.reduceat(add, at))
    for k, image in dense.items():
        flat = np.flatnonzero(touched[k])
        for a in range(0, len(flat), 1 << 16):
            part = flat[a : a + (1 << 16)]
            yield rows(k, part, image[part])


def _placed(df: DataFrame, camera: Camera, pos: Column, size: Column, value: Column) -> DataFrame:
    u, v, _ = camera.placed(pos)
    x = (u + F.lit(camera.width / 2)) * F.lit(camera.npix_width / camera.width)
    y = (v + F.lit(camera.height / 2)) * F.lit(camera.npix_height / camera.height)
    return df.filter(camera.region(pos)).select(F.lit(0).alias("level"), x.alias("x"), y.alias("y"), size.cast("double").alias("size"), value.cast("double").alias("value"))


def project(df: DataFrame, camera: Camera, pos: Column, size: Column, value: Column, per_area: bool = True, micro: bool = False) -> DataFrame:
    """iy, ix and value of the pixels that rows with their centre inside the camera's box reach. ``size``: kernel radius (see ``kernel_size``).

    ``per_area``: divided by the pixel's area. ``micro``: whole millionths for each deposit, so that sums do not depend on order.
    """
    nx, ny = camera.npix_width, camera.npix_height
    rows = _placed(df, camera, pos, size, value).select("level", "x", "y", (F.col("size") * F.lit(nx / camera.width)).alias("h"), "value")
    kind = "long" if micro else "double"
    made = rows.mapInArrow(lambda it: _deposit(it, {0: (nx, ny)}, micro), f"level int, iy int, ix int, value {kind}")
    out = made.groupBy("iy", "ix").agg(F.sum("value").alias("value"))
    return out.withColumn("value", F.col("value") / F.lit(camera.area_per_pixel)) if per_area else out


def levels_of(camera: Camera, largest: float, factor: float = 3, npix_min: int = 128) -> list[tuple[float, float, int]]:
    """(lower, upper, npix) of kernel sizes for each grid, coarsest first."""
    n = camera.npix
    if n & (n - 1):
        raise ValueError("nested grids need a power of two of pixels")
    low = min(n, max(npix_min, 2 ** math.ceil(math.log2(max(1e-300, camera.width / largest * factor)))))
    grids = [2**k for k in range(int(math.log2(low)), int(math.log2(n)) + 1)]
    edges = [math.inf, *(camera.width / g * factor for g in grids[:-1]), 0.0]
    return [(edges[i + 1], edges[i], g) for i, g in enumerate(grids)]


def project_nested(df: DataFrame, camera: Camera, pos: Column, size: Column, value: Column, factor: float = 3, npix_min: int = 128, per_area: bool = True, micro: bool = False) -> DataFrame:
    """As ``project``, with large kernels deposited on coarse grids whose pixels are then shared out evenly to the fine ones.

    A row's stencil stays below about ``(2 * factor + 2)^2`` pixels, whatever its kernel's size.
    """
    largest = df.filter(camera.region(pos)).agg(F.max(size).alias("m")).first()["m"]
    if largest is None:
        return project(df, camera, pos, size, value, per_area, micro)
    levels = levels_of(camera, largest, factor, npix_min)
    ratio = camera.height / camera.width
    sizes = {i: (n, int(round(n * ratio))) for i, (_, _, n) in enumerate(levels)}
    level = F.lit(len(levels) - 1)
    for i, (lower, _, _) in reversed(list(enumerate(levels))[:-1]):
        level = F.when(F.col("size") >= F.lit(lower), F.lit(i)).otherwise(level)
    grid = F.element_at(F.array(*[F.lit(float(n)) for _, _, n in levels]), F.col("level") + 1)
    rows = _placed(df, camera, pos, size, value).withColumn("level", level)
    scale = grid / F.lit(float(camera.npix))
    rows = rows.select("level", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"), (F.col("size") * grid / F.lit(camera.width)).alias("h"), "value")
    kind = "long" if micro else "double"
    made = rows.mapInArrow(lambda it: _deposit(it, sizes, micro), f"level int, iy int, ix int, value {kind}")
    coarse = made.groupBy("level", "iy", "ix").agg(F.sum("value").cast("double").alias("value"))
    times = F.element_at(F.array(*[F.lit(camera.npix // n) for _, _, n in levels]), F.col("level") + 1)
    steps = F.sequence(F.lit(0), F.col("k") - 1)
    fine = coarse.withColumn("k", times).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    fine = fine.select((F.col("iy") * F.col("k") + F.col("dy")).alias("iy"), (F.col("ix") * F.col("k") + F.col("dx")).alias("ix"), (F.col("value") / (F.col("k") * F.col("k"))).alias("value"))
    out = fine.groupBy("iy", "ix").agg(F.sum("value").alias("value"))
    return out.withColumn("value", F.col("value") / F.lit(camera.area_per_pixel)) if per_area else out


def ratio(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Pixelwise quotient of two images; null where the lower one is zero or missing."""
    return top.select("iy", "ix", F.col("value").alias("__t")).join(bottom.select("iy", "ix", F.col("value").alias("__b")), ["iy", "ix"]).select("iy", "ix", F.try_divide("__t", "__b").alias("value"))


def dense(image: DataFrame, camera: Camera) -> np.ndarray:
    """An image as an array [height, width] on the driver, zero where there is no row."""
    out = np.zeros((camera.npix_height, camera.npix_width))
    for batch in image.select("iy", "ix", "value").toArrow().to_batches():
        iy, ix, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out[iy, ix] = v
    return out
