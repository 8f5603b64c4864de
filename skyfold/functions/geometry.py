"""Geometric predicates: boxes, rotated boxes and spherical shells, each with an optional margin for each row.

A predicate is the exact comparison together with plain bounds on the coordinates, which reach the scan as pushed
filters. The bounds are widened by a relative 1e-12, so that they never decide. Comparisons are strict, but for a shell's inner radius. No periodic wrapping.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..orientation import Orientation
from .vectors import less, parts

SLACK = 1e-12


def _bounds(pos: Column, center: Sequence[float], half: Sequence[float]) -> Column:
    out = None
    for c, m, w in zip(parts(pos), center, half):
        reach = abs(w) + SLACK * (abs(m) + abs(w))
        both = (c > F.lit(float(m - reach))) & (c < F.lit(float(m + reach)))
        out = both if out is None else out & both
    return out


def _and(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def box(pos: Column, center: Sequence[float], widths: Sequence[float], margin: Column | None = None, largest_margin: float | None = None) -> Column:
    """Inside a box by half its widths, plus the row's margin. With a margin, its largest value makes the bounds possible."""
    d = less(pos, center)
    half = [F.lit(w / 2) + margin if margin is not None else F.lit(w / 2) for w in widths]
    exact = _and([F.abs(x) < h for x, h in zip(d, half)])
    if margin is None or largest_margin is not None:
        exact = _bounds(pos, center, [w / 2 + (largest_margin or 0.0) for w in widths]) & exact
    return exact


def rotated_box(pos: Column, center: Sequence[float], widths: Sequence[float], orientation: Orientation, margin: Column | None = None, largest_margin: float | None = None) -> Column:
    """Inside a box along an orientation's perp1, perp2 and normal."""
    d = less(pos, center)
    tests = []
    for row, w in zip(orientation.inverse, widths):
        along = d[0] * F.lit(float(row[0])) + d[1] * F.lit(float(row[1])) + d[2] * F.lit(float(row[2]))
        tests.append(F.abs(along) < (F.lit(w / 2) + margin if margin is not None else F.lit(w / 2)))
    exact = _and(tests)
    if margin is None or largest_margin is not None:
        half = np.array([w / 2 + (largest_margin or 0.0) for w in widths])
        exact = _bounds(pos, center, (np.abs(orientation.matrix) @ half).tolist()) & exact
    return exact


def shell(pos: Column, center: Sequence[float], r_max: float, r_min: float = 0.0, margin: Column | None = None, largest_margin: float | None = None) -> Column:
    """Distance from the centre below r_max and not below r_min; a margin moves both outwards and inwards."""
    x, y, z = less(pos, center)
    r2 = x * x + y * y + z * z
    if margin is None:
        exact = (r2 < F.lit(float(r_max) * float(r_max))) & (r2 >= F.lit(float(r_min) * float(r_min)))
    else:
        outer, inner = F.lit(float(r_max)) + margin, F.lit(float(r_min)) - margin
        exact = (r2 < outer * outer) & (r2 >= F.when(F.lit(float(r_min)) > margin, inner * inner).otherwise(F.lit(0.0)))
    if margin is None or largest_margin is not None:
        exact = _bounds(pos, center, [r_max + (largest_margin or 0.0)] * 3) & exact
    return exact


def in_box(pos: Column, low: Sequence, high: Sequence) -> Column:
    """Inside a closed box from its lower to its upper corner (numbers or columns)."""
    return _and([(c >= a) & (c <= b) for c, a, b in zip(parts(pos), _columns(low), _columns(high))])


def box_gap_square(pos: Column, low: Sequence, high: Sequence) -> Column:
    """Squared distance to a closed box, zero inside."""
    d = [F.greatest(F.lit(0.0), a - c, c - b) for c, a, b in zip(parts(pos), _columns(low), _columns(high))]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def box_distance(pos: Column, low: Sequence, high: Sequence) -> Column:
    return F.sqrt(box_gap_square(pos, low, high))


def box_meets_sphere(low: Sequence, high: Sequence, center: Column, radius: Column | float) -> Column:
    """Whether a closed box and a closed ball share a place."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return box_gap_square(center, low, high) <= r * r


def _columns(corner: Sequence) -> list[Column]:
    return [c if isinstance(c, Column) else F.lit(float(c)) for c in corner]
