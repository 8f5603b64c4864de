"""Near-duplicate documents by wide SimHash signatures over word shingles.

Similarity is the Jaccard similarity J of the documents' sets of ``shingle`` words. A SimHash of ``64 * WORDS`` bits estimates it: two
large sets differ in each bit with probability acos(2J / (1 + J)) / pi; the standard error at J = 0.8 is 0.03. For small sets, where
counts tie, that probability is summed from the binomials, so that the radius depends on the size of the smaller set.

Candidates share a band of minimum shingle hashes (J = 0.8 shares one but for 3 pairs in a million). Inside a band's groups the signatures
are compared bit-sliced. Pairs well within the radius are links, of which a spanning forest leaves the task. Pairs near it, up to ``BEYOND`` deviations
out, are open: their two members are named, once for the first band that they share. Named members that are not linked yet come back to the same group with their sets of shingles, where all open
pairs are compared exactly; again a spanning forest leaves the task. So no pair leaves a task but as a link, whatever the size of a group. Pairs whose sizes alone rule the similarity out are left out.
Copies of a text are one member.

A group of over ``GROUP`` members or ``SHINGLES`` shingles is dealt over chunks, which are compared within themselves first. What is linked by then needs no further comparison with itself:
members outside the group's largest component are then compared with all others, chunk by chunk. So a tight group of any size costs in proportion to its size, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .bitslice import close_pairs, components_of, forest
from .components import components
from .spark_util import cut, release

WORDS, BANDS, ROWS, GROUP = 8, 24, 4, 1024
#: Shingles of a chunk's members together (8 bytes each).
SHINGLES = 4 << 20
#: Texts with open pairs whose keys are sent to all tasks (some 50 bytes each); more go through a shuffle.
SENT = 200_000
#: Bytes of bit rows, and open pairs, that are compared at once.
BIT_BYTES, OPEN_PAIRS = 16 << 20, 1 << 16
#: Deviations of the distance within which a pair is a link without a look at its shingles, and beyond which it is none.
WITHIN, BEYOND = 5.0, 5.0
#: Sets of this size and more count as one: what their differing bits exceed the limit by falls with the size.
LARGE = 64
#: Pairs compared in one piece.
PAIRS = 1 << 21
_SEEDS = tk.mixed(np.arange(1, 1 + BANDS * ROWS + WORDS, dtype=tk.U) * tk.U(0x9E3779B97F4A7C15))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)


def _heads(n: int) -> np.ndarray:
    """Probabilities of 0 to n heads of n coins."""
    log = np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]
    return np.exp(log[n] - log - log[::-1] - n * math.log(2))


def differing(a: int, b: int, common: int) -> float:
    """Probability that a bit differs between sets of ``a`` and ``b`` shingles, ``common`` of them in both; a tie of the count gives 0."""
    at = np.arange(common + 1)

    def over(n: int, own: int) -> np.ndarray:
        below = np.r_[0.0, np.cumsum(_heads(own))]
        return 1 - below[np.clip(n // 2 - at + 1, 0, own + 1)]

    one, two = over(a, a - common), over(b, b - common)
    return float(_heads(common) @ (one * (1 - two) + two * (1 - one)))


@lru_cache
def radii(similarity: float, bits: int = 64 * WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distances by the size of the smaller set, the last for ``LARGE`` and more: those up to which a pair is a link, and beyond which it is none."""
    sure, reach = np.zeros(LARGE + 1, np.int64), np.zeros(LARGE + 1, np.int64)
    sure[1:] = bits
    for n in range(1, LARGE + LARGE // 2):
        k = min(n, LARGE)
        for b in range(n, int(n / similarity + 1e-9) + 1):
            least = math.ceil(similarity * (n + b) / (1 + similarity) - 1e-9)
            p = differing(n, b, least) if least <= n else 0.0
            reach[k] = max(reach[k], math.floor(bits * p + BEYOND * math.sqrt(bits * p * (1 - p))))
            if least > 0:
                p = differing(n, b, least - 1)
                sure[k] = min(sure[k], max(0, math.floor(bits * p - WITHIN * math.sqrt(bits * p * (1 - p)))))
    return np.minimum(sure, reach), reach


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def shingles_of(words: tk.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their documents, which ascend; fewer words are one shingle."""
    per_doc = np.diff(words.first)
    h = tk.word_hashes(words)
    at = np.flatnonzero(words.room() >= shingle)
    short = np.flatnonzero((per_doc > 0) & (per_doc < shingle))
    parts = [(tk.window_hashes(h, at, shingle), words.doc_of()[at])]
    parts += [(tk.window_hashes(h, words.first[[d]], int(per_doc[d])), np.array([d])) for d in short]
    return _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def signatures_of(words: tk.Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures [documents, WORDS] and band keys [documents, BANDS] over distinct shingles, and their number; no words give zeros."""
    n = len(words.first) - 1
    sigs, bands = np.zeros((n, WORDS), tk.U), np.zeros((n, BANDS), tk.U)
    h, doc = shingles_of(words, shingle)
    sizes = np.bincount(doc, minlength=n)
    if not len(h):
        return sigs, bands, sizes
    have, start = np.unique(doc, return_index=True)
    mins = np.stack([np.minimum.reduceat((h ^ s) * (s | tk.U(1)), start) for s in _SEEDS[: BANDS * ROWS]], 1)
    key = np.zeros((len(have), BANDS), tk.U)
    for r in range(ROWS):
        key = tk.mixed((key + tk.U(r + 1)) ^ mins[:, r::ROWS])
    bands[have] = key
    total = np.diff(np.r_[start, len(h)])
    step = 256
    for w in range(WORDS):
        octets = tk.mixed(h ^ _SEEDS[BANDS * ROWS + w]).view(np.uint8).reshape(-1, 8)
        for a in range(0, len(have), step):
            b = min(len(have), a + step)
            lo, hi = start[a], start[b] if b < len(have) else len(h)
            base = np.repeat(np.arange(b - a) << 8, total[a:b])
            for o in range(8):
                counts = np.bincount(base + octets[lo:hi, o], minlength=(b - a) << 8).reshape(b - a, 256)
                bits = (2 * (counts @ _BITS) > total[a:b, None]).astype(np.uint8)
                sigs[have[a:b], w] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(tk.U) << tk.U(8 * o)
    return sigs, bands, sizes


def _mark(docs: DataFrame, shingle: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [signatures_of(w, shingle) for w in tk.chunks(batch.column("text"), tk.SPACED, lower=True)]
            sigs, bands, sizes = (np.concatenate(x) for x in zip(*got))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["id", "copy", "sig", "bands", "size"])

    return docs.mapInArrow(of, "id long, copy string, sig binary, bands array<long>, size long")


class _Unit:
    """Members of groups (or of two chunks of one) as arrays; rows of a group follow one another."""

    def __init__(self, table: dict[str, np.ndarray], lo: int, hi: int, group: np.ndarray):
        self.keys, self.node, self.root, self.size, self.own, self.sigs, self.bands = (table[c][lo:hi] for c in ("keys", "node", "root", "size", "own", "sigs", "bands"))
        self.sets = table["sets"][lo:hi] if "sets" in table else None
        self.group = group

    def pairs(self, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs i, j that neither signatures nor sizes rule out and whose roots differ, their distance, and whether it makes them a link."""
        sure, reach = radii(similarity)
        i, j, far = close_pairs(self.sigs, self.group, int(reach[np.minimum(self.size, LARGE)].max()))
        low, high = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        fit = (far <= reach[np.minimum(low, LARGE)]) & (low >= (similarity - 1e-9) * high) & (self.root[i] != self.root[j])
        # two chunks that meet have been compared within themselves
        fit &= (self.own[i] != self.own[j]) | (self.keys[i, 2] == self.keys[i, 3])
        i, j, far, low = i[fit], j[fit], far[fit], low[fit]
        return i, j, far, far <= sure[np.minimum(low, LARGE)]

    def labels(self) -> np.ndarray:
        """For each member the first one of its root."""
        label = np.unique(self.root, return_inverse=True)[1]
        return np.unique(label, return_index=True)[1][label]

    def mine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a pair's band is the first that its members share."""
        out = np.ones(len(i), bool)
        for a in range(0, len(i), OPEN_PAIRS):
            p, q = i[a : a + OPEN_PAIRS], j[a : a + OPEN_PAIRS]
            out[a : a + OPEN_PAIRS] = ~((self.bands[p] == self.bands[q]) & (np.arange(BANDS) < self.keys[p, :1])).any(1)
        return out

    def links(self, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A spanning forest i, j of the sure links, and the members of open pairs that it does not join."""
        n = len(self.node)
        i, j, far, close = self.pairs(similarity)
        label = self.labels()
        firm = np.flatnonzero(close)
        firm = firm[forest(n, i[firm], j[firm], far[firm], label)]
        joined = components_of(n, np.r_[i[firm], np.arange(n)], np.r_[j[firm], label])
        rest = np.flatnonzero(~close & (joined[i] != joined[j]))
        rest = rest[self.mine(i[rest], j[rest])]
        return i[firm], j[firm], np.unique(np.r_[i[rest], j[rest]])

    def exact(self, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest i, j of the open pairs whose sets of shingles are similar enough, the likeliest first."""
        i, j, far, close = self.pairs(similarity)
        rest = np.flatnonzero(~close)
        rest = rest[self.mine(i[rest], j[rest])]
        rest = rest[np.argsort(far[rest], kind="stable")]
        i, j = i[rest], j[rest]
        if not len(i):
            return i, j
        shared = _Shared(self.sets)
        n, joined, found = len(self.node), self.labels(), []
        while len(i):
            p, q = i[:OPEN_PAIRS], j[:OPEN_PAIRS]
            common = shared.common(p, q)
            good = np.flatnonzero(common >= (similarity - 1e-9) * (self.size[p] + self.size[q] - common))
            good = good[forest(n, p[good], q[good], np.zeros(len(good)), joined)]
            found.append((p[good], q[good]))
            joined = components_of(n, np.r_[p[good], np.arange(n)], np.r_[q[good], joined])
            i, j = i[OPEN_PAIRS:], j[OPEN_PAIRS:]
            apart = joined[i] != joined[j]
            i, j = i[apart], j[apart]
        return tuple(np.concatenate([f[x] for f in found]) for x in range(2))


class _Shared:
    """Sets of hashes as rows of bits over the hashes that two sets or more hold."""

    def __init__(self, sets: list[np.ndarray]):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        keep = count[column] > 1
        self.n, self.row, self.column = len(sets), row[keep], place[column[keep]]
        self.width = int(place[-1]) + 1 if len(place) else 0

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many hashes the sets i and j share, for each pair."""
        out = np.zeros(len(i), np.int64)
        columns = max(64, BIT_BYTES // max(1, self.n) // 8 * 64)
        for a in range(0, self.width, columns):
            words = -(-min(columns, self.width - a) // 64)
            here = (self.column >= a) & (self.column < a + columns)
            octets = np.zeros((self.n, 8 * words), np.uint8)
            at = self.column[here] - a
            np.bitwise_or.at(octets, (self.row[here], at >> 3), (1 << (at & 7)).astype(np.uint8))
            bits, step = octets.view(tk.U), max(1, (1 << 20) // words)
            for b in range(0, len(i), step):
                out[b : b + step] += np.bitwise_count(bits[i[b : b + step]] & bits[j[b : b + step]]).sum(1, dtype=np.int64)
        return out


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "size", "own")}
    out["keys"] = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "low", "high")], 1)
    out["sigs"] = np.frombuffer(tk.buffers(batch.column("sig"))[0].tobytes(), tk.U).reshape(-1, WORDS)
    out["bands"] = batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    if "set" in batch.schema.names:
        data, at = tk.buffers(batch.column("set"))
        whole = np.frombuffer(data.tobytes(), tk.U)
        sets = np.empty(batch.num_rows, object)
        sets[:] = [whole[a // 8 : b // 8] for a, b in zip(at[:-1], at[1:])]
        out["sets"] = sets
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[_Unit]:
    """Whole groups, some at a time; a group that is cut by the end of a batch waits for the next."""

    def of(table: dict[str, np.ndarray], n: int) -> Iterator[_Unit]:
        keys = table["keys"][:n]
        edge = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, n]
        size = np.diff(edge)
        cost = np.cumsum(size * size)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
            yield _Unit(table, edge[at], edge[to], np.repeat(np.arange(to - at), size[at:to]))
            at = to

    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _columns(batch)
        ends = np.flatnonzero((new["keys"][1:] != new["keys"][:-1]).any(1)) + 1
        if held and (held[-1]["keys"][-1] != new["keys"][0]).any():
            ends = np.r_[0, ends]
        if not len(ends):
            held.append(new)
            continue
        last = int(ends[-1])
        held.append({c: v[:last] for c, v in new.items()})
        table = {c: np.concatenate([h[c] for h in held]) for c in new}
        yield from of(table, len(table["node"]))
        held = [{c: v[last:] for c, v in new.items()}]
    if held:
        table = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        yield from of(table, len(table["node"]))


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("band", "key", "low", "high", "own", "node", "root", "size", "sig", "bands", *more).repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high")


def _scanned(rows: DataFrame, similarity: float) -> DataFrame:
    """u and v of sure links between the members (band, key, low, high, own, node, root, size, sig, bands) that share band, key, low and high, or those four and the node of a member with an open pair."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            i, j, named = unit.links(similarity)
            none, void = pa.nulls(len(named), pa.int64()), pa.nulls(len(i), pa.int64())
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(unit.node[i]), pa.array(unit.node[j]), *[void] * 6], names)
            if len(named):
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(unit.keys[named, k]) for k in range(4)), pa.array(unit.own[named]), pa.array(unit.node[named])], names)

    names = ["u", "v", "band", "key", "low", "high", "own", "node"]
    return cut(_dealt(rows).mapInArrow(of, ", ".join(f"{n} long" for n in names)))


def _verified(rows: DataFrame, similarity: float) -> DataFrame:
    """u and v of links between members, with their sets, that share band, key, low and high."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            i, j = unit.exact(similarity)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(unit.node[i]), pa.array(unit.node[j])], ["u", "v"])

    return _dealt(rows, "set").mapInArrow(of, "u long, v long")


def _sets(nodes: DataFrame, texts: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """node and set (hashes as bytes) of ``nodes``, from one row of each text."""
    need = cut(nodes.distinct().join(texts.select("node", "copy"), "node"))
    if need.count() <= SENT:
        need = F.broadcast(need)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in tk.chunks(batch.column("text"), tk.SPACED, lower=True):
                n = len(words.first) - 1
                h, doc = shingles_of(words, shingle)
                at = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(words.row, n), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["node", "set"])

    return cut(keyed.join(need, "copy").select("node", "text").dropDuplicates(["node"]).mapInArrow(of, "node long, set binary"))


class _Groups:
    """Near-duplicate groups of the texts of ``docs``; ``marked`` has a row for each row of theirs, ``texts`` one for each text."""

    def __init__(self, docs: DataFrame, shingle: int, similarity: float, group: int):
        self.shingle, self.similarity = shingle, similarity
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.md5(text.cast("binary")).alias("copy"), text.alias("text"))
        self.marked = cut(_mark(self.keyed, shingle))
        # one member for each text, under a number that the written table fixes
        each = self.marked.groupBy("copy").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"), F.min("sig").alias("sig"), F.min("bands").alias("bands"), F.min("size").alias("size"))
        self.texts = cut(each.withColumn("node", F.monotonically_increasing_id()))
        keys = self.texts.select("node", "size", F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("long"))
        sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).filter("n > 1")
        chunks = F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("s") / SHINGLES), F.lit(1))
        live = cut(keys.join(sizes.select("band", "key", chunks.alias("chunks")), ["band", "key"]).select("node", "size", "band", "key", "chunks"))
        chunk = F.pmod(F.xxhash64("node", "band"), F.col("chunks"))
        self.roots: DataFrame | None = None
        self._round(live.withColumn("own", chunk).withColumn("low", chunk).withColumn("high", chunk).withColumn("root", F.col("node")))
        hot = live.filter("chunks > 1")
        if hot.take(1):
            self._round(self._between(hot, group))

    def _join(self, edges: DataFrame) -> None:
        self.roots = components(edges if self.roots is None else edges.union(self.roots))

    def _rooted(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("v", "node")).drop("v")

    def _round(self, members: DataFrame) -> None:
        """Link members (band, key, low, high, own, node, root): sure links first, then the open pairs between what is still apart."""
        shown = self.texts.select("node", "size", "sig", "bands")
        found = _scanned(members.drop("size").join(shown, "node"), self.similarity)
        self._join(found.filter("u IS NOT NULL").select("u", "v"))
        named = found.filter("u IS NULL").drop("u", "v")
        if named.take(1):
            sets = _sets(named.select("node"), self.texts, self.keyed, self.shingle)
            self._join(_verified(self._rooted(named).join(shown, "node").join(sets, "node"), self.similarity))
            release(sets)
        release(found)

    def _between(self, hot: DataFrame, group: int) -> DataFrame:
        """Members of hot groups, copied for each chunk that they meet: pairs of which one at least is outside the group's largest component so far."""
        rooted = self._rooted(hot)
        each = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
        top = each.groupBy("band", "key").agg(F.max(F.struct("n", "root", "s")).alias("t"), F.sum("n").alias("n"), F.sum("s").alias("s"))

        def chunks(n: Column, s: Column) -> Column:
            return F.greatest(F.ceil(n / group), F.ceil(s / SHINGLES))

        top = top.select("band", "key", F.col("t.root").alias("top"), chunks(F.col("t.n"), F.col("t.s")).alias("inside"), chunks(F.col("n") - F.col("t.n"), F.col("s") - F.col("t.s")).alias("outside"))
        dealt = rooted.join(top.filter("outside > 0"), ["band", "key"]).withColumn("most", F.col("root") == F.col("top"))
        draw = F.xxhash64("node", "band")
        dealt = dealt.withColumn("own", F.when(F.col("most"), F.pmod(draw, F.col("inside"))).otherwise(F.col("inside") + F.pmod(draw, F.col("outside"))))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("most"), F.col("inside")).otherwise(F.lit(0).cast("long")), F.col("inside") + F.col("outside") - 1)))
        return dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).select("node", "size", "band", "key", "low", "high", "own", "root")

    def named(self) -> DataFrame:
        """``texts`` with their root."""
        return self._rooted(self.texts.select("node", "copy", "least"))


def groups_of(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """id, copy (a key of the text) and root for each row: rows with the same root are near duplicates, reachable over pairs of that similarity."""
    found = _Groups(docs, shingle, similarity, group)
    return found.marked.select("id", "copy").join(found.named().select("copy", "root"), "copy")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with their own columns, that stand for their group: of each group of near duplicates the one with the smallest doc_id.

    Null and blank texts have no shingles and are one group. A null doc_id comes after all others. Of rows that share doc_id and text one stays. An empty table gives an empty result.
    """
    found = _Groups(docs, shingle, similarity, GROUP)
    # minima first, so that a group of a third of all rows is one row for each task
    least = found.named().groupBy("root").agg(F.min(F.struct("least.none", "least.id", "copy")).alias("m"))
    kept = least.select(F.col("m.id").alias("__id"), F.col("m.copy").alias("__copy"))
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__own", F.col("doc_id").cast("long")).withColumn("__md5", F.md5(text.cast("binary")))
    same = rows["__own"].eqNullSafe(kept["__id"]) & (rows["__md5"] == kept["__copy"])
    stay = rows.join(kept, same, "left_semi")
    if found.marked.groupBy("id", "copy").count().filter("count > 1").take(1):
        stay = stay.dropDuplicates(["__own", "__md5"])
    return stay.select(*[F.col(f"`{c}`") for c in names])
