"""Approximate nearest neighbours by stable projections, a kd-tree, and a chi-square stopping test.

Vectors are projected to a few dimensions with Gaussian (2-stable) directions: the squared projected distance of two vectors is
their squared distance times a chi-square variable. A query reads base rows in the order of projected distance and verifies each on the original vectors. It stops at the first row whose projected distance, given the
current k-th best distance, would be exceeded with probability ``confidence`` by a row that close: what a true neighbour would
have to do to lie further out. Each true neighbour is found with that probability at least.

Layout: a kd-tree of at most ``MAX_LEAVES`` cells is fitted on a bounded sample and every row is put into its cell; a cell with many rows, such as one of a
vector that a third of all rows share, is dealt over blocks, of which there are some ``MAX_BLOCKS`` at most. In the first round each query searches the block with the nearest bounding box, which bounds its
k-th distance; in the second it goes to those blocks only whose bounding box is within the stopping radius of that bound. Within a block a second kd-tree with small buckets is walked for some queries at a time:
each verifies the rows with the least projected distance first, then those that its stopping radius, in the light of what it has found, still lets in; a bucket that no query's radius reaches is
not looked at. A block with many queries is copied for portions of them.

The largest inner product is turned into the least distance by one more coordinate, sqrt(M^2 - |x|^2).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import cut

#: Rows on which the cells are fitted, cells, blocks, rows of a block, queries that a copy of a block serves, rows of a bucket, queries that walk a block together.
SAMPLE, MAX_LEAVES, MAX_BLOCKS, BLOCK_ROWS, BLOCK_QUERIES, BUCKET, TOGETHER = 20_000, 4096, 16_384, 8192, 4096, 64, 128
DIMS, CONFIDENCE = 16, 0.97


def chi2_cdf(x: float, m: int) -> float:
    """Chi-square distribution function for an even number of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with ``dim`` components, none of them null or not finite and not all zero, and their vectors."""
    rows = np.flatnonzero(pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    part = column.take(pa.array(rows))
    x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], np.ascontiguousarray(x[good])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))


class Projection:
    """Directions for base rows and queries of dimension ``dim`` whose largest norm is ``top``."""

    def __init__(self, dim: int, top: float, m: int, seed: int):
        self.dim, self.top = dim, top
        self.directions = np.random.default_rng(seed).standard_normal((dim + 1, m))

    def base(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0.0, self.top**2 - (x * x).sum(1)))
        return x @ self.directions[:-1] + more[:, None] * self.directions[-1]

    def query(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.top / np.sqrt((q * q).sum(1)))[:, None]) @ self.directions[:-1]


class Cells:
    """A kd-tree over projected sample rows, as arrays; cells are its leaves."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.dim, self.at, self.child = [], [], []
        self.n = 0
        if leaves > 1 and len(points):
            self._split(points, leaves)
        else:
            self.n = 1

    def _split(self, points: np.ndarray, leaves: int) -> int:
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if leaves < 2 or len(points) < 2 or spread.max() == 0:
            self.n += 1
            return -self.n
        d = int(np.argmax(spread))
        at = float(np.median(points[:, d]))
        low = points[:, d] < at
        if not low.any():
            at = float(points[points[:, d] > at, d].min())
            low = points[:, d] < at
        node = len(self.dim)
        self.dim.append(d)
        self.at.append(at)
        self.child.append([0, 0])
        self.child[node][0] = self._split(points[low], leaves // 2)
        self.child[node][1] = self._split(points[~low], leaves - leaves // 2)
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        if not self.dim:
            return out
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                out[who] = -node - 1
            elif len(who):
                low = points[who, self.dim[node]] < self.at[node]
                todo += [(self.child[node][0], who[low]), (self.child[node][1], who[~low])]
        return out


class Block:
    """The rows of one block, in kd-tree buckets."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projection: Projection):
        p = projection.base(x)
        order, edges, todo = [], [], [np.arange(len(ids))]
        while todo:
            who = todo.pop()
            spread = np.ptp(p[who], axis=0) if len(who) else np.zeros(1)
            if len(who) <= BUCKET or spread.max() == 0:
                order.append(who)
                edges.append(len(who))
                continue
            by = np.argpartition(p[who, int(np.argmax(spread))], len(who) // 2)
            todo += [who[by[: len(who) // 2]], who[by[len(who) // 2 :]]]
        order = np.concatenate(order)
        self.ids, self.x, self.p = ids[order], x[order], p[order]
        self.end = np.cumsum(edges)
        self.start = self.end - edges
        self.low = np.minimum.reduceat(self.p, self.start)
        self.high = np.maximum.reduceat(self.p, self.start)
        self.bucket = np.repeat(np.arange(len(edges)), edges)

    def search(self, q: np.ndarray, own: np.ndarray, at: np.ndarray, k: int, bound: np.ndarray, factor: float, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and inner product of the best k rows but a query's ``own`` id, nearest first, among those the stopping test lets in.

        ``bound``: k-th squared distance that is known already; what is further is not returned. ``factor``: quantile of the chi-square test.
        """
        found = [self._walk(q[a : a + TOGETHER], own[a : a + TOGETHER], at[a : a + TOGETHER], k, bound[a : a + TOGETHER], factor, top, a) for a in range(0, len(q), TOGETHER)]
        return tuple(np.concatenate([f[x] for f in found]) for x in range(3))

    def _best(self, who: np.ndarray, row: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best k of the pairs (query, row), by query and nearest first: query, row, exact score, and each query's k-th score (minus infinity, if fewer)."""
        other = self.ids[row] != own[who]
        who, row = who[other], row[other]
        # summed in one fixed order, so that equal vectors have equal scores
        score = np.concatenate([np.zeros(0), *((self.x[row[a : a + 8192]] * q[who[a : a + 8192]]).sum(1) for a in range(0, len(row), 8192))])
        order = np.lexsort((self.ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        first = np.searchsorted(who, np.arange(len(q)))
        place = np.arange(len(who)) - first[who]
        kth = np.full(len(q), -np.inf)
        kth[who[place == k - 1]] = score[place == k - 1]
        return who[place < k], row[place < k], score[place < k], kth

    def _walk(self, q: np.ndarray, own: np.ndarray, at: np.ndarray, k: int, bound: np.ndarray, factor: float, top: float, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slack = 1e-9 * top * top
        norm = np.sqrt((q * q).sum(1))
        least = (2 * top * top - bound) * norm / (2 * top)  # the score of a row at the bound
        near = np.zeros((len(q), len(self.low)))
        for d in range(at.shape[1]):
            gap = np.maximum(0, np.maximum(self.low[:, d] - at[:, d, None], at[:, d, None] - self.high[:, d]))
            near += gap * gap
        # buckets that some query's radius reaches
        rows = np.flatnonzero((near <= (factor * bound + slack)[:, None]).any(0)[self.bucket])
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        p = self.p[rows]
        far = np.maximum(0, (at * at).sum(1)[:, None] + (p * p).sum(1) - 2 * (at @ p.T))
        far[self.ids[rows] == own[:, None]] = np.inf
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        if not np.isfinite(bound).all():
            # the nearest by projection are verified first
            n = min(len(rows), max(64, 2 * k))
            head = np.argpartition(far, n - 1, axis=1)[:, :n]
            who, row, score, kth = self._best(np.repeat(np.arange(len(q)), n), rows[head.ravel()], q, own, k)
            kept.append((who, row))
            least = np.maximum(least, kth)
            bound = np.minimum(bound, np.maximum(0, 2 * top * top - 2 * top * least / norm))
            np.put_along_axis(far, head, np.inf, axis=1)
        # all that the stopping test lets in; what the k-th distance rules out needs no exact score
        inside = np.isfinite(far) & (far <= (factor * bound + slack)[:, None])
        some = np.flatnonzero(inside.any(0))
        rough = q @ self.x[rows[some]].T
        who, col = np.nonzero(inside[:, some] & (rough >= (least - 1e-12 * top * norm)[:, None]))
        kept.append((who, rows[some[col]]))
        who, row, score, _ = self._best(np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]), q, own, k)
        good = score >= (least - 1e-12 * top * norm)[who]
        return who[good] + base, self.ids[row[good]], score[good]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = 7, block_rows: int = BLOCK_ROWS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product in double precision) of the nearest ``k`` rows found for each query.

    ``queries``: predicate on the rows of ``vectors``; each matching row is a query against every row but those of its own id. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do rows without an id or of another length than the most frequent one. Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty table gives none.
    Repeated rows count as candidates each; of query rows that share an id the one with the least vector asks.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[vector_column] == "array<float>" else "double"
    raw = vectors.withColumn("__query", F.coalesce(queries, F.lit(False)))
    rows = raw.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast(f"array<{kind}>").alias("v"), F.col("__query").alias("is_query")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    shape = "query_id long, rank int, vec_id long, score double"

    def measure(batches):
        for b in batches:
            column = b.column("v")
            for d in pc.unique(pc.list_value_length(column)).to_pylist():
                x = usable(column, d)[1] if d else np.zeros((0, 0))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([(x * x).sum(1).max()])], ["d", "n", "m"])

    sizes = rows.select("v").mapInArrow(measure, "d int, n long, m double").groupBy("d").agg(F.sum("n").alias("n"), F.max("m").alias("m")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], shape)
    dim, n = sizes["d"], sizes["n"]
    top = math.sqrt(sizes["m"]) * (1 + 1e-12)
    block_rows = max(block_rows, -(-n // MAX_BLOCKS))
    projection, factor = Projection(dim, top, dims, seed), chi2_quantile(confidence, dims)
    drawn = rows if n <= SAMPLE else rows.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    sample = projection.base(usable(drawn.select("v").limit(2 * SAMPLE).toArrow().column("v").combine_chunks(), dim)[1])
    cells = Cells(sample[np.lexsort(sample.T)], min(MAX_LEAVES, -(-n // block_rows)))

    def place(batches):
        for b in batches:
            good, x = usable(b.column("v"), dim)
            if len(good):
                part = b.take(pa.array(good))
                p = projection.base(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.of(p)), pa.array(list(p), pa.list_(pa.float64()))], [*part.schema.names, "leaf", "p"])

    placed = cut(rows.mapInArrow(place, f"vec_id long, v array<{kind}>, is_query boolean, leaf long, p array<double>"))
    # a cell is dealt over as many blocks as its rows need; the table of cells has MAX_LEAVES rows at most
    deal = {r["leaf"]: -(-r["count"] // (2 * block_rows)) for r in placed.groupBy("leaf").count().collect()}
    first, at = {}, 0
    for leaf in sorted(deal):
        first[leaf], at = at, at + deal[leaf]
    small = F.broadcast(spark.createDataFrame([(x, first[x], deal[x]) for x in deal], "leaf long, first long, deal long"))
    placed = placed.join(small, "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("deal")))
    base = placed.select("vec_id", "v", "block")
    asked = placed.filter("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))

    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("block").agg(*edges).collect()
    boxes.sort(key=lambda r: r["block"])
    number = np.array([r["block"] for r in boxes])
    low = np.array([[r[f"lo{i}"] for i in range(dims)] for r in boxes])
    high = np.array([[r[f"hi{i}"] for i in range(dims)] for r in boxes])

    def gaps(p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), len(low)))
        for d in range(dims):
            gap = np.maximum(0, np.maximum(low[:, d] - p[:, d, None], p[:, d, None] - high[:, d]))
            out += gap * gap
        return out

    def pieces(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                yield b.slice(a, 1024)

    def go_home(batches):
        for b in pieces(batches):
            gap = gaps(projection.query(_matrix(b.column("v"), dim)))
            # blocks of one cell overlap: queries are dealt over those that are equally near
            best = gap <= gap.min(1)[:, None]
            pick = [number[np.flatnonzero(r)[q % r.sum()]] for r, q in zip(best, (tk.mixed(b.column("query_id").to_numpy().astype(np.uint64)) >> np.uint64(32)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("v"), pa.array(pick, pa.int64()), pa.array(np.full(b.num_rows, np.inf))], ["query_id", "v", "block", "bound"])

    pairs = f"query_id long, v array<{kind}>, block long, bound double"
    result = pa.schema([("query_id", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return result.empty_table()
        data = Block(left.column("vec_id").to_numpy(), _matrix(left.column("v"), dim), projection)
        q, own = _matrix(right.column("v"), dim), right.column("query_id").to_numpy()
        who, ids, scores = data.search(q, own, projection.query(q), k, right.column("bound").to_numpy(), factor, top)
        edge = pa.array(np.searchsorted(who, np.arange(len(q) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (ids, scores)]
        return pa.Table.from_arrays([pa.array(own), right.column("block").combine_chunks(), *lists], schema=result)

    def run(to: DataFrame) -> DataFrame:
        portions = to.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).alias("portions"))
        left = base.join(portions, "block").select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"))
        right = to.join(portions, "block").withColumn("portion", F.pmod(F.xxhash64("query_id"), F.col("portions"))).drop("portions")
        return left.groupBy("block", "portion").cogroup(right.groupBy("block", "portion")).applyInArrow(lambda a, b: search(a, b), "query_id long, block long, ids array<long>, scores array<double>")

    home = cut(asked.mapInArrow(go_home, pairs))
    one = run(home)

    def spread(batches):
        for b in pieces(batches):
            q = _matrix(b.column("v"), dim)
            norm, gap = np.sqrt((q * q).sum(1)), gaps(projection.query(q))
            last = np.array([s[-1] if len(s) == k else -np.inf for s in b.column("scores").to_pylist()])
            bound = np.maximum(0, 2 * top * top - 2 * top * last / norm)
            go = (gap <= (factor * bound + 1e-9 * top * top)[:, None]) & (number != b.column("block").to_numpy()[:, None])
            who, to = np.nonzero(go)
            for a in range(0, len(who), 4096):
                part = who[a : a + 4096]
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(part)), b.column("v").take(pa.array(part)), pa.array(number[to[a : a + 4096]]), pa.array(bound[part])], ["query_id", "v", "block", "bound"])

    ahead = cut(one.join(home.select("query_id", "v"), "query_id"))
    two = run(cut(ahead.select("query_id", "v", "block", "scores").mapInArrow(spread, pairs)))
    found = ahead.select("query_id", "ids", "scores").union(two.select("query_id", "ids", "scores"))
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("z")).select("query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
