"""Bit-sliced Hamming distances: vertical bit planes, carry-save counters, blocks abandoned beyond the radius.

Bit b of 64 signatures (or of 64 pairs' differences) lies in one machine word. Each step adds two planes to a vertical counter with a carry-save adder, which
updates 64 distances by a few word operations. After every ``EVERY`` planes the words in which all 64 distances are beyond the radius are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U = np.uint64
ONES = U((1 << 64) - 1)
EVERY = 8
#: Groups of up to this many are compared pair by pair in common words; larger ones column by column.
SMALL = 64


def planes_of(sigs: np.ndarray) -> np.ndarray:
    """[bits, words]: bit planes of signatures [n, w]; unused columns of the last word are zero."""
    n, w = sigs.shape
    full = -(-n // 64) * 64
    octets = np.zeros((full, 8 * w), np.uint8)
    octets[:n] = np.ascontiguousarray(sigs).view(np.uint8).reshape(n, -1)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(U)


def _beyond(counter: list[np.ndarray], many: np.ndarray, radius: int) -> np.ndarray:
    """Where the vertical count is over the radius."""
    over, equal = many.copy(), np.full(many.shape, ONES)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            over |= equal & counter[k]
            equal &= ~counter[k]
    return over


def counted(plane: Callable[[int, np.ndarray], np.ndarray], n_planes: int, columns: np.ndarray, shape: tuple[int, ...], radius: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Columns that are left, the mask of distances beyond the radius there, and the counter's planes.

    ``plane(b, columns)``: differences in bit b, an array of ``shape`` whose last axis is the columns that are left.
    """
    width = (radius + 1).bit_length()
    counter = [np.zeros(shape, U) for _ in range(width)]
    many = np.zeros(shape, U)
    for b in range(0, n_planes, 2):
        x, y = plane(b, columns), plane(b + 1, columns)
        carry = (counter[0] & x) | (y & (counter[0] | x))
        counter[0] ^= x ^ y
        for k in range(1, width):
            carry, counter[k] = counter[k] & carry, counter[k] ^ carry
        many |= carry
        if (b + 2) % EVERY == 0 and b + 2 < n_planes and b + 2 > radius:
            alive = _beyond(counter, many, radius) != ONES
            alive = alive.reshape(-1, len(columns)).any(axis=0)
            if not alive.all():
                columns, many = columns[alive], many[..., alive]
                counter = [c[..., alive] for c in counter]
                if not len(columns):
                    break
    return columns, _beyond(counter, many, radius), counter


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _read(counter: list[np.ndarray], at: tuple[np.ndarray, ...], bit: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bit), np.int64)
    for k, c in enumerate(counter):
        out |= ((c[at] >> bit.astype(U)) & U(1)).astype(np.int64) << k
    return out


def _listed(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int, slab: int = 1 << 15) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for a in range(0, len(i), slab):
        p, q = i[a : a + slab], j[a : a + slab]
        planes = planes_of(sigs[p] ^ sigs[q])
        columns, over, counter = counted(lambda b, cols: planes[b, cols], len(planes), np.arange(planes.shape[1]), (planes.shape[1],), radius)
        if not len(columns):
            continue
        word, bit = np.nonzero(_bits(~over))
        at = columns[word] * 64 + bit
        ok = at < len(p)
        out.append((p[at[ok]], q[at[ok]], _read(counter, (word[ok],), bit[ok])))
    return out


def _gridded(sigs: np.ndarray, base: int, radius: int, rows: int = 128) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    planes, out, n = planes_of(sigs), [], len(sigs)
    for q0 in range(0, n, rows):
        q = sigs[q0 : q0 + rows]
        columns = np.arange(q0 // 64, planes.shape[1])  # those before were compared the other way round

        def plane(b: int, cols: np.ndarray) -> np.ndarray:
            flip = U(0) - ((q[:, b // 64] >> U(b % 64)) & U(1))
            return planes[b, cols][None, :] ^ flip[:, None]

        columns, over, counter = counted(plane, len(planes), columns, (len(q), len(columns)), radius)
        if not len(columns):
            continue
        r, w = np.nonzero(over != ONES)
        k, bit = np.nonzero(_bits(~over[r, w]))
        r, w = r[k], w[k]
        i, j = q0 + r, columns[w] * 64 + bit
        ok = (j > i) & (j < n)
        out.append((base + i[ok], base + j[ok], _read(counter, (r[ok], w[ok]), bit[ok])))
    return out


def close_pairs(sigs: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices i < j of signatures [n, w] in the same group that differ in at most ``radius`` bits, and how many. ``group`` ascends."""
    n = len(sigs)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n > 1:
        edge = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, n]
        size = np.diff(edge)
        first = np.repeat(edge[:-1], size)
        length = np.repeat(size, size)
        low, high = [], []
        small = np.flatnonzero(length <= SMALL)
        for s in range(1, min(SMALL, int(size.max()))):
            i = small[small - first[small] + s < length[small]]
            if len(i):
                low.append(i)
                high.append(i + s)
        if low:
            found += _listed(sigs, np.concatenate(low), np.concatenate(high), radius)
        for g in np.flatnonzero(size > SMALL):
            found += _gridded(sigs[edge[g] : edge[g + 1]], int(edge[g]), radius)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(f[x] for f in found)]) for x in range(3))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels once those in ``a`` and ``b`` are one, pair by pair; the smallest stays."""
    root = np.arange(len(label)).tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    at = np.unique(label)
    top = np.arange(len(label))
    top[at] = [find(x) for x in at.tolist()]
    return top[label]


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest of n nodes; nodes with one ``label`` are one node.

    Each round, every tree takes its lightest way out; the number of trees at least halves.
    """
    order = np.argsort(weight, kind="stable")
    i, j = i[order], j[order]
    label = np.arange(n) if label is None else label
    live, keep = np.arange(len(order)), []
    while True:
        a, b = label[i[live]], label[j[live]]
        out = a != b
        live, a, b = live[out], a[out], b[out]
        if not len(live):
            break
        best = np.full(n, len(order))
        best[a[::-1]] = live[::-1]  # ascending ranks: the lightest is written last
        other = np.full(n, len(order))
        other[b[::-1]] = live[::-1]
        best = np.minimum(best, other)
        pick = np.unique(best[best < len(order)])
        keep.append(pick)
        label = _merged(label, label[i[pick]], label[j[pick]])
    return order[np.concatenate(keep)] if keep else order[:0]


def components_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    return _merged(np.arange(n), i, j)
