"""SimHash fingerprints and exact near-duplicate components by bit-sliced comparison.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles. Pairs within the radius are found exactly: the 64 bits are cut
into ``radius + 2`` parts, so that two fingerprints within the radius agree on two parts at least, and each
pair of parts is a key. A key that too many fingerprints share is refined: its free bits are cut into ``radius + 1`` parts, of which
two close fingerprints agree on one, until the groups are small. No key is capped or dropped.

Inside a group, fingerprints are compared bit-sliced (see ``bitslice``): vertical bit planes, carry-save counters of many distances, and blocks
abandoned once all exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .bitslice import close_pairs, forest
from .components import components
from .spark_util import cut

U = np.uint64
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Fingerprints that a group may hold before its key is refined; 2**10 at least, since 10 free bits can't be exceeded.
GROUP = 4096


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


#: Longer spans go through the library one by one.
LONG = 4096


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte span, many at a time."""
    n = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    h = np.full(len(n), U(seed) + P5)
    stripes = np.flatnonzero((n >= 32) & (n <= LONG))
    if len(stripes):
        stripes = stripes[np.argsort(-n[stripes], kind="stable")]
        left, at = n[stripes] // 32, starts[stripes].astype(np.int64)
        v = [np.full(len(stripes), (seed + x) % (1 << 64), U) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        for k in range(int(left[0])):
            live = int(np.searchsorted(-left, -k, "left"))  # those with more than k stripes come first
            where = at[:live] + 32 * k
            for i in range(4):
                v[i][:live] = _rotl(v[i][:live] + lanes[where + 8 * i] * P2, 31) * P1
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for i in range(4):
            x = (x ^ (_rotl(v[i] * P2, 31) * P1)) * P1 + P4
        h[stripes] = x
    h += n.astype(U)
    start, rest = starts + n // 32 * 32, n % 32
    order = np.argsort(rest, kind="stable")
    edge = np.searchsorted(rest[order], np.arange(33))
    for size in range(32):
        who = order[edge[size] : edge[size + 1]]
        if not len(who):
            continue
        at, x, left = start[who], h[who], size
        while left >= 8:
            x = _rotl(x ^ (_rotl(lanes[at] * P2, 31) * P1), 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            x = _rotl(x ^ ((lanes[at] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at, left = at + 4, left - 4
        while left:
            x = _rotl(x ^ (padded[at].astype(U) * P5), 11) * P1
            at, left = at + 1, left - 1
        x = (x ^ (x >> U(33))) * P2
        x = (x ^ (x >> U(29))) * P3
        h[who] = x ^ (x >> U(32))
    raw = memoryview(data)
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed)
    return h


def one_space(words: tk.Words) -> tk.Words:
    """The same words with one space after each."""
    n = words.ends - words.starts
    ends = np.cumsum(n + 1) - 1
    starts = ends - n
    keep = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(keep, words.starts, 1)
    np.add.at(keep, words.ends, -1)
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    to = np.ones(len(out), bool)
    to[ends] = False
    out[to] = words.data[np.cumsum(keep[:-1]) > 0]
    return tk.Words(out, starts, ends, words.first, words.row)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)


def _majority(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, the bits that are set in over half of its hashes; ``doc`` ascends."""
    total = np.bincount(doc, minlength=n_docs)
    out = np.zeros(n_docs, U)
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    edge = np.r_[0, np.cumsum(total)]
    step = 512
    for a in range(0, n_docs, step):
        b = min(n_docs, a + step)
        lo, hi = edge[a], edge[b]
        base = (doc[lo:hi] - a) << 8
        for j in range(8):
            counts = np.bincount(base + octets[lo:hi, j], minlength=(b - a) << 8).reshape(b - a, 256)
            ones = counts.astype(np.float64) @ _BITS
            bits = (2 * ones > total[a:b, None]).astype(np.uint8)
            out[a:b] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(U) << U(8 * j)
    return out


def fingerprints_of(words: tk.Words, shingle: int, seed: int = 42) -> np.ndarray:
    """A fingerprint for each document of a chunk."""
    words = one_space(words)
    per_doc = np.diff(words.first)
    n_docs = len(per_doc)
    at = np.flatnonzero(words.room() >= shingle)
    doc = words.doc_of()
    short = np.flatnonzero((per_doc > 0) & (per_doc < shingle))
    starts = np.concatenate([words.starts[at], words.starts[words.first[short]]])
    ends = np.concatenate([words.ends[at + shingle - 1], words.ends[words.first[short + 1] - 1]])
    of = np.concatenate([doc[at], short])
    h = xxh64_spans(words.data, starts, ends, seed)
    order = np.argsort(of, kind="stable")
    return _majority(h[order], of[order], n_docs)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for each row. No words, or a null text: 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp = np.concatenate([fingerprints_of(w, shingle) for w in tk.chunks(batch.column("text"), tk.SPACED, lower=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fp long")


def _parts(free: list[int], n: int) -> list[int]:
    """Masks of n parts of the free bits."""
    return [sum(1 << b for b in free[k::n]) for k in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _roots(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the close pairs in each group of fingerprints."""
    for batch in batches:
        groups = batch.column(0)
        fps = groups.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(groups.offsets.to_numpy())
        i, j, far = close_pairs(fps.view(U)[:, None], np.repeat(np.arange(len(size)), size), radius)
        if len(i):
            few = forest(len(fps), i, j, far)
            yield pa.RecordBatch.from_arrays([pa.array(fps[i[few]]), pa.array(fps[j[few]])], ["u", "v"])


def links(fps: DataFrame, radius: int = 2, group: int = GROUP) -> DataFrame:
    """Edges (u, v) of long fingerprints that join exactly the components of all pairs within ``radius``. ``fps``: distinct fp, already written out."""
    if group < 1 << 10:
        raise ValueError("group must be 1024 at least")
    spark = fps.sparkSession
    masks = [a | b for a, b in combinations(_parts(list(range(64)), radius + 2), 2)]
    keys = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = []
    while True:
        keys = keys.withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        hot = keys.groupBy("mask", "val").count().filter(F.col("count") > group).select("mask", "val")
        hot = cut(hot)
        any_hot = bool(hot.take(1))
        cold = keys.join(hot, ["mask", "val"], "left_anti") if any_hot else keys
        groups = cold.groupBy("mask", "val").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
        found.append(groups.mapInArrow(lambda it: _roots(it, radius), "u long, v long"))
        if not any_hot:
            break
        finer = {m: [m | p for p in _parts([b for b in range(64) if not m >> b & 1], radius + 1)] for m in masks}
        table = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        keys = cut(keys.join(hot, ["mask", "val"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct())
        masks = sorted({s for subs in finer.values() for s in subs})
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for each row.

    ``docs``: columns doc_id and text; others are ignored. Texts are lower-cased (A-Z) and cut into words and shingles of
    ``shingle`` words, repeats included; fewer words are one shingle. A null or blank text has fingerprint zero, which links like any other. Rows
    with a null doc_id keep it; they take part in links, and the component of such rows alone has a null id. Repeated rows give repeated
    results; an empty table an empty one.
    """
    marked = cut(fingerprints(docs, shingle))
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select("fp"), radius, group))
    of = least.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
