"""Image geometry: centre, widths, direction or orientation, pixels; and scripted camera moves."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box, rotated_box
from ..functions.vectors import less
from ..orientation import Orientation

#: Width, height and depth axes of the image by direction.
AXES_OF = {"x": (1, 2, 0), "y": (2, 0, 1), "z": (0, 1, 2)}


@dataclass(frozen=True)
class Camera:
    """``widths`` along x, y and z of the direction's frame (of the orientation's triad where there is one). ``npix`` counts along the width."""

    center: tuple[float, float, float]
    widths: tuple[float, float, float]
    direction: str | Orientation = "z"
    npix: int = 512

    @property
    def axes(self) -> tuple[int, int, int]:
        return AXES_OF["z" if isinstance(self.direction, Orientation) else self.direction]

    width = property(lambda self: self.widths[self.axes[0]])
    height = property(lambda self: self.widths[self.axes[1]])
    depth = property(lambda self: self.widths[self.axes[2]])
    npix_width = property(lambda self: self.npix)

    @property
    def npix_height(self) -> int:
        exact = self.height / self.width * self.npix
        if abs(exact - round(exact)) > 1e-8 * max(1, exact):
            raise ValueError("height over width times npix is no whole number")
        return int(round(exact))

    area = property(lambda self: self.width * self.height)
    volume = property(lambda self: self.width * self.height * self.depth)
    area_per_pixel = property(lambda self: self.area / (self.npix_width * self.npix_height))
    volume_per_pixel = property(lambda self: self.volume / (self.npix_width * self.npix_height))

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """left, right, bottom, top; relative to the centre for an orientation."""
        w, h = self.width / 2, self.height / 2
        if isinstance(self.direction, Orientation):
            return -w, w, -h, h
        cw, ch = self.center[self.axes[0]], self.center[self.axes[1]]
        return cw - w, cw + w, ch - h, ch + h

    # -- rows

    def region(self, pos: Column, margin: Column | None = None, largest_margin: float | None = None) -> Column:
        """Predicate of the rows whose centres lie inside, by the margin at most outside."""
        if isinstance(self.direction, Orientation):
            return rotated_box(pos, self.center, self.widths, self.direction, margin, largest_margin)
        return box(pos, self.center, self.widths, margin, largest_margin)

    def placed(self, pos: Column) -> tuple[Column, Column, Column]:
        """Coordinates along width, height and depth, relative to the centre."""
        d = less(pos, self.center)
        if isinstance(self.direction, Orientation):
            return tuple(d[0] * F.lit(float(r[0])) + d[1] * F.lit(float(r[1])) + d[2] * F.lit(float(r[2])) for r in self.direction.inverse)
        return tuple(d[i] for i in self.axes)

    def world(self, u: Column, v: Column, w: Column) -> list[Column]:
        """Position of image coordinates (relative to the centre)."""
        if isinstance(self.direction, Orientation):
            m = self.direction.matrix
            return [F.lit(float(self.center[i])) + (u * F.lit(float(m[i, 0])) + v * F.lit(float(m[i, 1])) + w * F.lit(float(m[i, 2]))) for i in range(3)]
        out: list[Column] = [F.lit(0.0)] * 3
        for axis, c in zip(self.axes, (u, v, w)):
            out[axis] = F.lit(float(self.center[axis])) + c
        return out

    def pixels(self, spark: SparkSession, npix_depth: int = 1) -> DataFrame:
        """iy, ix, iz and the position ``pos`` of each pixel's centre (voxel's, with more than one sample in depth)."""
        nx, ny = self.npix_width, self.npix_height
        grid = spark.range(nx * ny * npix_depth, numPartitions=max(1, min(200, nx * ny * npix_depth // 50_000 + 1)))
        iz = (F.col("id") % npix_depth).cast("int")
        ix = (F.floor(F.col("id") / npix_depth) % nx).cast("int")
        iy = F.floor(F.col("id") / (npix_depth * nx)).cast("int")
        named = grid.select(F.col("id").alias("pixel"), iy.alias("iy"), ix.alias("ix"), iz.alias("iz"))

        def middle(i: str, size: float, n: int) -> Column:
            return F.lit(-size / 2) + (F.col(i) + F.lit(0.5)) * F.lit(size / n)

        p = self.world(middle("ix", self.width, nx), middle("iy", self.height, ny), middle("iz", self.depth, npix_depth))
        return named.select("pixel", "iy", "ix", "iz", F.struct(*[c.alias(n) for c, n in zip(p, "xyz")]).alias("pos"))

    def image_coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        """Pixel centres along width and height as two arrays [height, width]."""
        l, r, b, t = self.extent
        x = l + (np.arange(self.npix_width) + 0.5) * (r - l) / self.npix_width
        y = b + (np.arange(self.npix_height) + 0.5) * (t - b) / self.npix_height
        return np.meshgrid(x, y)

    def centered_coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.image_coordinates()
        l, r, b, t = self.extent
        return x - (l + r) / 2, y - (b + t) / 2

    # -- moves; each gives a new camera

    def zoom(self, factor: float) -> Camera:
        return replace(self, widths=tuple(w / factor for w in self.widths))

    def resized(self, width: float | None = None, height: float | None = None, depth: float | None = None) -> Camera:
        new = list(self.widths)
        for axis, w in zip(self.axes, (width, height, depth)):
            if w is not None:
                new[axis] = w
        return replace(self, widths=tuple(new))

    def _along(self, axis: int) -> np.ndarray:
        return self.direction.matrix[:, axis] if isinstance(self.direction, Orientation) else np.eye(3)[self.axes[axis]]

    def move(self, width: float = 0.0, height: float = 0.0, depth: float = 0.0) -> Camera:
        """Shifted along the image's own axes."""
        shift = sum(d * self._along(k) for k, d in enumerate((width, height, depth)))
        return replace(self, center=tuple((np.asarray(self.center) + shift).tolist()))

    def recentered(self, center) -> Camera:
        return replace(self, center=tuple(center))

    def double_resolution(self) -> Camera:
        return replace(self, npix=self.npix * 2)

    def half_resolution(self) -> Camera:
        return replace(self, npix=self.npix // 2)

    def rotated(self, about: str, degrees: float) -> Camera:
        """Turned about normal, perp1, perp2, x, y or z."""
        if not isinstance(self.direction, Orientation):
            raise ValueError("only a camera with an orientation can turn")
        return replace(self, direction=getattr(self.direction, f"rotate_around_{about}")(degrees=degrees))

    def describe(self) -> dict:
        d = {"center": list(self.center), "widths": list(self.widths), "extent": list(self.extent), "npix_width": self.npix_width, "npix_height": self.npix_height}
        if isinstance(self.direction, Orientation):
            return d | {"direction": "orientation", "normal_vector": self.direction.normal.tolist(), "perp_vector1": self.direction.perp1.tolist()}
        return d | {"direction": self.direction}

    @staticmethod
    def from_description(d: dict) -> Camera:
        direction = Orientation(normal=d["normal_vector"], perp1=d["perp_vector1"]) if d["direction"] == "orientation" else d["direction"]
        return Camera(tuple(d["center"]), tuple(d["widths"]), direction, d["npix_width"])


MOVES = ("zoom", "resized", "move", "recentered", "double_resolution", "half_resolution", "rotated")


class Script:
    """A log of camera moves that can be saved, read, replayed and refined."""

    def __init__(self, camera: Camera):
        self.start, self.steps, self.waypoints = camera, [], {}

    def do(self, move: str, *args) -> Script:
        if move not in MOVES:
            raise ValueError(f"no such move: {move}")
        self.steps.append((move, list(args)))
        return self

    def waypoint(self, name: str) -> Script:
        self.waypoints[name] = len(self.steps)
        return self

    def cameras(self, since: str | None = None) -> list[Camera]:
        """The camera after each step, from a waypoint on if one is named."""
        out = [self.start]
        for move, args in self.steps:
            out.append(getattr(out[-1], move)(*args))
        return out[self.waypoints[since] if since else 0 :]

    def subdivided(self, max_zoom: float, max_degrees: float) -> Script:
        """The same path in steps of at most a zoom factor and an angle."""
        new = Script(self.start)
        marks = {at: n for n, at in self.waypoints.items()}
        for at, (move, args) in enumerate(self.steps):
            if at in marks:
                new.waypoint(marks[at])
            if move == "zoom":
                n = max(1, int(np.ceil(abs(np.log(args[0])) / np.log(max_zoom) - 1e-9)))
                parts = [(move, [args[0] ** (1 / n)])] * n
            elif move == "rotated":
                n = max(1, int(np.ceil(abs(args[1]) / max_degrees - 1e-9)))
                parts = [(move, [args[0], args[1] / n])] * n
            else:
                parts = [(move, args)]
            new.steps += parts
        if len(self.steps) in marks:
            new.waypoint(marks[len(self.steps)])
        return new

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"start": self.start.describe(), "steps": self.steps, "waypoints": self.waypoints}, f)

    @staticmethod
    def load(path: str) -> Script:
        with open(path) as f:
            raw = json.load(f)
        out = Script(Camera.from_description(raw["start"]))
        out.steps, out.waypoints = [(m, a) for m, a in raw["steps"]], raw["waypoints"]
        return out
