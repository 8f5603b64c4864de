"""Exact removal of repeated word windows, found through difference-cover anchors.

A window is ``window`` consecutive words. Instead of hashing every window of the corpus, anchors of
``window - period + 1`` words are hashed only at the positions of a difference cover modulo
``period``: whatever the two places of a repeated window are, some shift below ``period`` brings both
onto the cover, so both places hold the same anchor. Only windows around an anchor that occurs twice
are then extended to full windows and compared by 96 bits of hash. Both parts are made of 64-bit
hashes of the words, so two different words with equal hashes (a chance of 1 in 2^64 a pair) count as one word.

Plan, each step over hash-dealt blocks of a few MB of text:

1. each block sends the distinct anchors it holds (twice what it holds twice) to hash buckets;
2. a bucket sends back to each block those that occur again anywhere;
3. the block extends them to windows, settles repeats inside the block, and sends the first place of
   each window to buckets once more;
4. a bucket keeps the earliest place of each window and reports the others to their blocks;
5. the block drops the covered words.

A block sends a hash at most twice and a window once, so a passage that a third of all documents share costs a
bucket one entry for each block, not one for each document. Texts are shuffled once; steps 1, 3 and 5
read the same exchange, and a lost executor's part is made again from the input.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import blocks_for, text_bytes

#: Perfect difference covers: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BLOCK_BYTES = 8 << 20
LOW40 = tk.U((1 << 40) - 1)
PLACE = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("at", "<u4")])
NO_ID = -(1 << 63)


#: Blocks up to which each is dealt to a partition of its own.
EVEN_BLOCKS = 1 << 16


def _even_keys(spark: SparkSession, n: int) -> DataFrame:
    """__p and block: for each partition of ``n`` a number that Spark's hash partitioning deals to it. A partition may be missing (3 in 10,000 times, for any n)."""
    key = F.col("id").cast("int")
    return spark.range(int(n * (math.log(n) + 8)) + 1).select(key.alias("block"), F.pmod(F.hash(key), F.lit(n)).alias("__p")).groupBy("__p").agg(F.min("block").alias("block"))


def period_for(window: int) -> int:
    """The longest period whose anchors keep at least a third of the window."""
    return max(p for p in COVERS if window - p + 1 >= max(1, window / 3))


def _ordered(docs: pa.Table) -> pa.Table:
    """A block's rows by (doc_id, text), the same in each pass."""
    ids = docs.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return docs.take(pa.array(order))


def _buckets(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> tk.U(32)) * tk.U(n)) >> tk.U(32)


def _runs(values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(1, int)


def _dealt(bucket: np.ndarray, payload: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One blob for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, payload = bucket[order], payload[order]
    edge = _runs(bucket)
    return [int(bucket[a]) for a in edge[:-1]], [payload[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]


class _Anchors:
    def __init__(self, window: int, n_buckets: int):
        self.window, self.n_buckets = window, n_buckets
        self.period = period_for(window)
        self.width = window - self.period + 1
        self.cover = np.zeros(self.period, bool)
        self.cover[list(COVERS[self.period])] = True

    def of(self, words: tk.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions on the cover of their document, and the anchors' hashes."""
        room = words.room()
        at = np.arange(len(hashes)) - np.repeat(words.first[:-1], np.diff(words.first))
        long_enough = np.repeat(np.diff(words.first) >= self.window, np.diff(words.first))
        places = np.flatnonzero(self.cover[at % self.period] & (room >= self.width) & long_enough)
        return places, tk.window_hashes(hashes, places, self.width)

    def send(self, docs: pa.Table) -> pa.Table:
        got = [np.zeros(0, tk.U)]
        for words in tk.chunks(docs.column("text"), tk.SPACED, lower=False):
            got.append(self.of(words, tk.word_hashes(words))[1])
        keys = np.sort(np.concatenate(got))
        keep = np.ones(len(keys), bool)
        keep[2:] = keys[2:] != keys[:-2]
        keys = keys[keep]
        buckets, blobs = _dealt(_buckets(keys, self.n_buckets), keys)
        block = docs.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([block] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def again(self, sent: pa.Table) -> pa.Table:
        """For each block, those of its anchors that occur again."""
        blobs = sent.column("blob").to_pylist()
        keys = np.concatenate([np.frombuffer(b, tk.U) for b in blobs])
        block = np.repeat(sent.column("block").to_numpy(), [len(b) // 8 for b in blobs])
        order = np.lexsort((block, keys))
        keys, block = keys[order], block[order]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        twice = same[:-1] | same[1:]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])
        to, out = _dealt(block[twice & first], keys[twice & first])
        return pa.table({"block": pa.array(to, pa.int32()), "keys": pa.array(out, pa.binary())})

    def extend(self, docs: pa.Table, again: pa.Table) -> pa.Table:
        """Windows around the repeated anchors: bucket -1 and word ranges for those that a block settles itself, else their first places."""
        empty = {"bucket": pa.int32(), "block": pa.int32(), "blob": pa.binary()}
        if not len(docs) or not len(again):
            return pa.table({k: pa.array([], v) for k, v in empty.items()})
        known = np.sort(np.concatenate([np.frombuffer(b, tk.U) for b in again.column("keys").to_pylist()]))
        docs = _ordered(docs)
        ids = docs.column("doc_id").to_numpy()
        got, base = [np.zeros(0, PLACE)], 0
        for words in tk.chunks(docs.column("text"), tk.SPACED, lower=False):
            hashes = tk.word_hashes(words)
            places, keys = self.of(words, hashes)
            where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = places[known[where] == keys]
            # windows [s, s + window) that hold [hit, hit + width): s from hit - period + 1 to hit
            count = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(count, np.maximum(hit - self.period + 1, 0), 1)
            np.add.at(count, hit + 1, -1)
            start = np.flatnonzero((np.cumsum(count)[:-1] > 0) & (words.room() >= self.window))
            rows = np.zeros(len(start), PLACE)
            rows["h1"] = tk.window_hashes(hashes, start, self.window, 0)
            rows["h2"] = tk.window_hashes(hashes, start, self.window, 1) >> tk.U(32)
            rows["doc"] = ids[words.row + np.searchsorted(words.first, start, "right") - 1]
            rows["at"] = start + base
            got.append(rows)
            base += len(hashes)
        rows = np.concatenate(got)
        order = np.lexsort((rows["at"], rows["h2"], rows["h1"]))
        rows = rows[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
        block = docs.column("block")[0].as_py()
        buckets, blobs = _dealt(_buckets(rows["h1"][first], self.n_buckets), rows[first])
        later = np.sort(rows["at"][~first])
        if len(later):
            edge = np.r_[0, np.flatnonzero(np.diff(later.astype(np.int64)) > 1) + 1, len(later)]
            runs = np.stack([later[edge[:-1]], later[edge[1:] - 1]], 1).astype(np.uint32)
            buckets.append(-1 - block % self.n_buckets)
            blobs.append(runs.tobytes())
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([block] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def settle(self, sent: pa.Table) -> pa.Table:
        """For each block, the runs of window starts that repeat an earlier place."""
        if sent.column("bucket")[0].as_py() < 0:
            return pa.table({"block": sent.column("block"), "runs": sent.column("blob")})
        blobs = sent.column("blob").to_pylist()
        rows = np.concatenate([np.frombuffer(b, PLACE) for b in blobs])
        block = np.repeat(sent.column("block").to_numpy(), [len(b) // PLACE.itemsize for b in blobs])
        order = np.lexsort((rows["doc"], rows["h2"], rows["h1"]))
        rows, block = rows[order], block[order]
        later = np.zeros(len(rows), bool)
        later[1:] = (rows["h1"][1:] == rows["h1"][:-1]) & (rows["h2"][1:] == rows["h2"][:-1])
        at = rows["at"][later].astype(np.uint32)
        to, out = _dealt(block[later], np.stack([at, at], 1))
        return pa.table({"block": pa.array(to, pa.int32()), "runs": pa.array(out, pa.binary())})

    def removed(self, docs: pa.Table, runs: pa.Table) -> tuple[pa.Table, list[tuple[tk.Words, np.ndarray]]]:
        """The block's rows in order, and for each chunk of them its words and which of them go."""
        docs = _ordered(docs)
        found = np.concatenate([np.zeros((0, 2), np.uint32), *(np.frombuffer(b, np.uint32).reshape(-1, 2) for b in runs.column("runs").to_pylist())]).astype(np.int64)
        out, base = [], 0
        for words in tk.chunks(docs.column("text"), tk.SPACED, lower=False):
            n = len(words.starts)
            mine = found[(found[:, 0] >= base) & (found[:, 0] < base + n)] - base
            count = np.zeros(n + 1, np.int64)
            np.add.at(count, mine[:, 0], 1)
            np.add.at(count, np.minimum(mine[:, 1] + self.window, n), -1)
            out.append((words, np.cumsum(count)[:-1] > 0))
            base += n
        return docs, out


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = 20, block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """Remove each word that lies in a window whose words also start earlier in the corpus.

    ``docs``: columns doc_id and text; others are ignored. Earlier means a smaller doc_id, or the same document and an
    earlier start. One row for each input row: doc_id, n_words, n_removed and kept_text (kept words joined by
    one space), or with ``digest`` the kept text's SHA-256 in its place.

    A null text has no words. A null doc_id counts as smaller than any other and stays null; such rows are ordered, and dealt over blocks, by a hash of their text. Rows that
    share a doc_id are one block and ordered by text; of repeated rows the later ones lose their words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = blocks_for(spark, text_bytes(docs), block_bytes)
    step = _Anchors(window, n)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("doc_id").cast("long").isNull().alias("none"))
    rows = rows.withColumn("doc_id", F.when(F.col("none"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))).otherwise(F.col("doc_id")))
    dealt = rows.withColumn("__p", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    if n <= EVEN_BLOCKS:
        # no partition gets several blocks while others get none; a pair of numbers for each block is sent to all tasks
        dealt = dealt.join(F.broadcast(_even_keys(spark, n)), "__p", "left").withColumn("block", F.coalesce("block", "__p"))
    else:
        dealt = dealt.withColumn("block", F.col("__p"))
    dealt = dealt.drop("__p").repartition(n, "block")
    blobs, keys, runs = "bucket int, block int, blob binary", "block int, keys binary", "block int, runs binary"
    again = dealt.groupBy("block").applyInArrow(lambda t: step.send(t), blobs).groupBy("bucket").applyInArrow(lambda t: step.again(t), keys)
    places = dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(lambda a, b: step.extend(a, b), blobs)
    later = places.groupBy("bucket").applyInArrow(lambda t: step.settle(t), runs)

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        kept, counts = [], []
        if len(block):
            block, parts = step.removed(block, found)
        else:
            parts = []
        for words, gone in parts:
            data = words.data.tobytes()
            sums = np.r_[0, np.cumsum(gone)]
            for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                dropped = int(sums[b] - sums[a])
                if a == b:
                    text = b""
                else:
                    all_words = data[words.starts[a] : words.ends[b - 1]].split()
                    text = b" ".join(all_words if not dropped else [w for w, g in zip(all_words, gone[a:b].tolist()) if not g])
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                counts.append((int(b - a), dropped))
        none = block.column("none").to_numpy() if len(block) else np.zeros(0, bool)
        ids = pa.array(block.column("doc_id").to_numpy(), mask=none.astype(bool)) if len(block) else pa.array([], pa.int64())
        return pa.table({"doc_id": ids, "n_words": pa.array([c[0] for c in counts], pa.int64()), "n_removed": pa.array([c[1] for c in counts], pa.int64()), "kept_sha256" if digest else "kept_text": pa.array(kept, pa.string())})

    return dealt.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(finish, DIGEST if digest else RESULT)
