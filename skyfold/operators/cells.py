"""A kd-tree of points for nearest-neighbour and radius queries inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points that may be sent to each task, with a few values each (some 50 MB).
SENT_POINTS = 500_000
#: Points of a leaf at most, queries that descend together, pairs of a query and a node or of a query and a point that are held at once.
LEAF, TOGETHER, PAIRS = 32, 8192, 1 << 20


class PointTree:
    """Points in a balanced kd-tree, split at medians, for exact answers to many queries at once. Dense and empty places are alike to it."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
        order, edges = np.arange(n), np.array([0, n])
        for _ in range(self.depth):
            size = np.diff(edges)
            p, node = points[order], np.repeat(np.arange(len(size)), size)
            wide = np.argmax(np.maximum.reduceat(p, edges[:-1]) - np.minimum.reduceat(p, edges[:-1]), axis=1)
            order = order[np.lexsort((p[np.arange(n), wide[node]], node))]
            finer = np.empty(2 * len(edges) - 1, np.int64)
            finer[0::2], finer[1::2] = edges, (edges[:-1] + edges[1:]) // 2
            edges = finer
        self.order, self.points, self.edges = order, points[order], edges
        self.low, self.high = [np.minimum.reduceat(self.points, edges[:-1])], [np.maximum.reduceat(self.points, edges[:-1])]
        for _ in range(self.depth):
            self.low.insert(0, np.minimum(self.low[0][0::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][0::2], self.high[0][1::2]))

    def _gap(self, level: int, node: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distance from each query to a node's box; never above that to a point in it."""
        d = np.maximum(0, np.maximum(self.low[level][node] - q, q - self.high[level][node]))
        return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]

    def _met(self, q: np.ndarray, rows: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point index and squared distance for all points of each pair's leaf."""
        size = self.edges[leaf + 1] - self.edges[leaf]
        who = np.repeat(rows, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.edges[leaf], size)
        d = self.points[at] - q[who]
        return who, self.order[at], d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]

    def _leaves(self, q: np.ndarray, reach: np.ndarray, rows: np.ndarray, node: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of a query and a leaf within ``reach`` (squared, read anew at each step), with their gap; a part at a time."""
        while level < self.depth:
            if len(rows) > PAIRS and len(rows) > 1:
                half = len(rows) // 2
                yield from self._leaves(q, reach, rows[:half], node[:half], level)
                yield from self._leaves(q, reach, rows[half:], node[half:], level)
                return
            level += 1
            rows, node = np.repeat(rows, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            gap = self._gap(level, node, q[rows])
            near = gap <= reach[rows]
            rows, node = rows[near], node[near]
        if len(rows):
            yield rows, node, self._gap(level, node, q[rows])

    def nearest(self, q: np.ndarray, not_here: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest point, -1 where there is none; ties to the smaller index. ``not_here``: only points at a distance above zero."""
        best, who = np.full(len(q), np.inf), np.full(len(q), -1, np.int64)
        for a in range(0, len(q), TOGETHER):
            best[a : a + TOGETHER], who[a : a + TOGETHER] = self._nearest(q[a : a + TOGETHER], not_here)
        return who, best

    def _nearest(self, q: np.ndarray, not_here: bool) -> tuple[np.ndarray, np.ndarray]:
        best, who = np.full(len(q), np.inf), np.full(len(q), -1, np.int64)

        def look(rows: np.ndarray, leaf: np.ndarray) -> None:
            row, index, d2 = self._met(q, rows, leaf)
            keep = (d2 <= best[row]) & (d2 > 0) if not_here else d2 <= best[row]
            row, index, d2 = row[keep], index[keep], d2[keep]
            order = np.lexsort((index, d2, row))
            pick = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
            pick = pick[(d2[pick] < best[row[pick]]) | (who[row[pick]] < 0) | (index[pick] < who[row[pick]])]
            best[row[pick]], who[row[pick]] = d2[pick], index[pick]

        home = np.zeros(len(q), np.int64)
        for level in range(1, self.depth + 1):
            home = 2 * home
            home += self._gap(level, home + 1, q) < self._gap(level, home, q)
        step = PAIRS // LEAF
        for a in range(0, len(q), step):
            look(np.arange(a, min(len(q), a + step)), home[a : a + step])
        for rows, leaf, gap in self._leaves(q, best, np.arange(len(q)), np.zeros(len(q), np.int64), 0):
            other = leaf != home[rows]
            rows, leaf, gap = rows[other], leaf[other], gap[other]
            order = np.argsort(gap, kind="stable")
            for a in range(0, len(order), step // 4):
                part = order[a : a + step // 4]
                part = part[gap[part] <= best[rows[part]]]
                if len(part):
                    look(rows[part], leaf[part])
        return best, who

    def within(self, q: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, point index and squared distance of all points no further than ``radius``; all of a query's points in one part."""
        limit = radius * radius
        reach = np.full(len(q), limit)
        a, together = 0, 64
        while a < len(q):
            some = np.arange(a, min(len(q), a + together))
            pairs = list(self._leaves(q, reach, some, np.zeros(len(some), np.int64), 0))
            found = []
            for rows, leaf, _ in pairs:
                for b in range(0, len(rows), PAIRS // LEAF):
                    row, index, d2 = self._met(q, rows[b : b + PAIRS // LEAF], leaf[b : b + PAIRS // LEAF])
                    near = d2 <= limit
                    found.append((row[near], index[near], d2[near]))
            out = tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k < 2 else float) for k in range(3))
            yield out
            a += together
            # as many queries at once as give some hundred thousand pairs
            together = int(np.clip(together * (PAIRS // 4) / max(1, len(out[0])), 1, min(TOGETHER, 4 * together)))
