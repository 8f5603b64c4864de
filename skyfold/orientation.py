"""Right-handed orthonormal triads and their rotations."""

from __future__ import annotations

import numpy as np


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    size = np.sqrt(v @ v)
    if not size > 0:
        raise ValueError("a vector of length zero has no direction")
    return v / size


def any_perpendicular(v) -> np.ndarray:
    """A unit vector at right angles to ``v``, built from its two largest components."""
    v = _unit(v)
    out = np.zeros(3)
    drop = int(np.argmin(np.abs(v)))
    i, j = (k for k in range(3) if k != drop)
    out[i], out[j] = -v[j], v[i]
    return _unit(out)


class Orientation:
    """Columns perp1, perp2 and normal of a rotation; made from any two of the vectors, or one."""

    def __init__(self, normal=None, perp1=None, perp2=None):
        given = [x is not None for x in (normal, perp1, perp2)]
        if sum(given) == 0 or sum(given) == 3:
            raise ValueError("give one or two of the three vectors")
        normal, perp1, perp2 = (None if x is None else _unit(x) for x in (normal, perp1, perp2))
        have = [x for x in (normal, perp1, perp2) if x is not None]
        if len(have) == 2 and abs(have[0] @ have[1]) > 1e-9:
            raise ValueError("the vectors are not perpendicular")
        if normal is not None and perp1 is None:
            perp1 = any_perpendicular(normal) if perp2 is None else np.cross(perp2, normal)
        elif normal is None and perp1 is not None:
            perp2 = any_perpendicular(perp1) if perp2 is None else perp2
            normal = np.cross(perp1, perp2)
        elif normal is None:
            normal = any_perpendicular(perp2)
            perp1 = np.cross(perp2, normal)
        self.matrix = np.stack([_unit(perp1), _unit(np.cross(normal, perp1)), _unit(normal)], axis=1)

    perp1 = property(lambda self: self.matrix[:, 0])
    perp2 = property(lambda self: self.matrix[:, 1])
    normal = property(lambda self: self.matrix[:, 2])

    @property
    def inverse(self) -> np.ndarray:
        """Rows perp1, perp2, normal: takes a vector to the triad's coordinates."""
        return self.matrix.T

    @staticmethod
    def _turn(axis: np.ndarray, angle: float) -> np.ndarray:
        """Rotation about a unit axis (Rodrigues)."""
        x, y, z = axis
        skew = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        return np.eye(3) + np.sin(angle) * skew + (1 - np.cos(angle)) * skew @ skew

    def _rotated(self, axis, degrees: float | None, radians: float | None) -> Orientation:
        if (degrees is None) == (radians is None):
            raise ValueError("give degrees or radians")
        new = Orientation.__new__(Orientation)
        new.matrix = self._turn(np.asarray(axis, float), np.deg2rad(degrees) if radians is None else radians) @ self.matrix
        return new

    def rotate_around_x(self, degrees=None, radians=None) -> Orientation:
        return self._rotated([1, 0, 0], degrees, radians)

    def rotate_around_y(self, degrees=None, radians=None) -> Orientation:
        return self._rotated([0, 1, 0], degrees, radians)

    def rotate_around_z(self, degrees=None, radians=None) -> Orientation:
        return self._rotated([0, 0, 1], degrees, radians)

    def rotate_around_normal(self, degrees=None, radians=None) -> Orientation:
        return self._rotated(self.normal, degrees, radians)

    def rotate_around_perp1(self, degrees=None, radians=None) -> Orientation:
        return self._rotated(self.perp1, degrees, radians)

    def rotate_around_perp2(self, degrees=None, radians=None) -> Orientation:
        return self._rotated(self.perp2, degrees, radians)

    def copy(self) -> Orientation:
        new = Orientation.__new__(Orientation)
        new.matrix = self.matrix.copy()
        return new

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Orientation) and bool(np.allclose(self.matrix, other.matrix, rtol=0, atol=1e-14))

    __hash__ = None
