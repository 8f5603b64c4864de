"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is some 300,000 words of whole documents. Its suffixes are put into a suffix array (prefix doubling on word ranks), and the windows of all test suffixes, each
distinct one once, are binary-searched in it, which gives their places. Words that no test item holds end a match, so suffixes that meet one before the shortest window is full can't match
and are left out of the array. What was found is put into one more suffix array together with the test suffixes that it matched, whole length: the longest
verbatim match of a place is the one with its nearest test suffix above or below. A place counts once for each window length, however often the test items hold its window.

The test items are searched in blocks: as many rounds as it takes for each block to stay below ``block_bytes``, which bounds what
is sent to the executors. Training texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import cut

BLOCK_BYTES = 8 << 20
#: Rounds after which what was found is written out with its texts, so that the driver holds so many blocks at most.
ROUNDS_A_CUT = 16
#: Text of a shard; its arrays take some 40 times as much.
SHARD_BYTES = 2 << 20


def _slots(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, .. for each i, ``size[i]`` of them."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


@dataclass
class ItemBlock:
    """Test items as word ids 1.. of their own vocabulary: tokens, and the distinct windows to look for.

    ``place`` and ``length``: where a distinct window stands first, and its words. ``window_of``: the distinct window at each token, or -1. ``holders[first[w]:first[w + 1]]``: the items that hold window w.
    """

    vocabulary: np.ndarray
    tokens: np.ndarray
    item_of: np.ndarray
    items: list[str]
    place: np.ndarray
    length: np.ndarray
    window_of: np.ndarray
    first: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, str]], window: int) -> ItemBlock:
        """``rows``: (item id as a string, text)."""
        texts = pa.array([t for _, t in rows], pa.string())
        parts = list(tk.chunks(texts, tk.ALNUM, lower=True))
        hashes = np.concatenate([np.zeros(0, tk.U), *(tk.word_hashes(w) for w in parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(w.first) for w in parts)])
        vocabulary, tokens = np.unique(hashes, return_inverse=True)
        tokens = tokens.astype(np.int64) + 1
        item_of = np.repeat(np.arange(len(counts)), counts)
        rest = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
        lengths = np.minimum(counts[item_of], window) if len(counts) else np.zeros(0, np.int64)
        window_of, place, length = np.full(len(tokens), -1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(lengths):
            at = np.flatnonzero((lengths == n) & (rest >= n))
            words = np.ascontiguousarray(tokens[at[:, None] + np.arange(n)].astype(np.int32))
            _, one, which = np.unique(words.view(np.dtype((np.void, 4 * int(n))))[:, 0], return_index=True, return_inverse=True)
            window_of[at] = sum(map(len, place)) + which
            place.append(at[one])
            length.append(np.full(len(one), n))
        place, length = np.concatenate(place), np.concatenate(length)
        held = np.flatnonzero(window_of >= 0)
        pairs = np.unique(window_of[held] * max(1, len(rows)) + item_of[held])
        first = np.searchsorted(pairs, np.arange(len(place) + 1) * max(1, len(rows)))
        return ItemBlock(vocabulary, tokens, item_of, [i for i, _ in rows], place, length, window_of, first, pairs % max(1, len(rows)))


def doubled(tokens: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 .. words, until those are ``depth`` at least; a 0 ends a text, has rank 0, and so has the place after the last."""
    n = len(tokens)
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = tokens
    width = 1
    yield rank
    live = np.flatnonzero(tokens)
    while width < depth and len(live):
        key = (rank[live] << 32) | rank[np.minimum(live + width, n)]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank, width = np.zeros(n + 1, np.int64), 2 * width
        rank[live[order]] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        yield rank


def suffix_array(tokens: np.ndarray, keep: np.ndarray, depth: int) -> np.ndarray:
    """Positions in ``keep``, ordered by the ``depth`` tokens at least that follow them."""
    for rank in doubled(tokens, depth):
        pass
    return keep[np.lexsort((keep, rank[keep]))]


def _room(tokens: np.ndarray) -> np.ndarray:
    """Words from each place on up to the next 0."""
    zero = np.r_[np.flatnonzero(tokens == 0), len(tokens)]
    return zero[np.searchsorted(zero, np.arange(len(tokens)))] - np.arange(len(tokens))


def _stretches(tokens: np.ndarray, part: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The covered places and the tokens there, a 0 after each stretch; stretches do not go from one ``part`` to the next. A 0 has place -1."""
    at = np.flatnonzero(covered)
    gap = np.r_[(at[1:] != at[:-1] + 1) | (part[at[1:]] != part[at[:-1]]), True] if len(at) else np.zeros(0, bool)
    where = np.arange(len(at)) + np.r_[0, np.cumsum(gap)[:-1]] if len(at) else at
    text, origin = np.zeros(len(at) + int(gap.sum()), np.int64), np.full(len(at) + int(gap.sum()), -1)
    text[where], origin[where] = tokens[at], at
    return text, origin


def longest_matches(text: np.ndarray, test: np.ndarray) -> np.ndarray:
    """For each place of ``text`` the words that agree with some place of ``test``; a 0 ends a match.

    One suffix array over both: of all test suffixes, the nearest above and below a place share most words with it. Words in common are read from the ranks, longest steps first.
    """
    both = np.concatenate([text, [0], test, [0]])
    room = _room(both)
    levels = [r.astype(np.int32) for r in doubled(both, int(room.max(initial=1)))]
    order = np.argsort(levels[-1][: len(both)], kind="stable")
    order = order[both[order] > 0]
    is_test = order > len(text)
    known = np.flatnonzero(is_test)
    out = np.zeros(len(text), np.int64)
    if not len(known):
        return out
    mine = np.flatnonzero(~is_test)
    after = np.searchsorted(known, mine)
    for near, there in ((np.maximum(after - 1, 0), after > 0), (np.minimum(after, len(known) - 1), after < len(known))):
        a, b = order[mine], order[known[near]]
        same = np.zeros(len(mine), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same += np.where(levels[k][np.minimum(a + same, len(both))] == levels[k][np.minimum(b + same, len(both))], 1 << k, 0)
        same = np.where(there, np.minimum(same, np.minimum(room[a], room[b])), 0)
        np.maximum.at(out, a, same)
    return out


class Shard:
    """The suffix array of some documents against one block of test items."""

    def __init__(self, tokens: np.ndarray, test: ItemBlock):
        self.test, self.tokens = test, tokens
        self.depth = int(test.length.max())
        run = _room(tokens)
        keep = np.flatnonzero(run >= int(test.length.min()))
        # only the stretches that hold kept suffixes, each closed by a 0
        cover = np.zeros(len(tokens) + 1, np.int32)
        np.add.at(cover, keep, 1)
        np.add.at(cover, np.minimum(keep + run[keep], len(tokens)), -1)
        self.text, self.origin = _stretches(tokens, np.zeros(len(tokens), np.int8), np.cumsum(cover[:-1]) > 0)
        to = np.full(len(tokens) + 1, -1, np.int64)
        real = self.origin >= 0
        to[self.origin[real]] = np.flatnonzero(real)
        self.array = suffix_array(self.text, to[keep], self.depth)

    def _prefixes(self, upper: bool) -> np.ndarray:
        """For each distinct window, the first place in the array whose prefix is not below (upper: is above) it."""
        pattern_at, length = self.test.place, self.test.length
        text, tokens = np.r_[self.text, np.zeros(self.depth, np.int64)], np.r_[self.test.tokens, np.zeros(self.depth, np.int64)]
        lo, hi = np.zeros(len(pattern_at), np.int64), np.full(len(pattern_at), len(self.array), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            s, p = self.array[mid], pattern_at[open_]
            order = np.zeros(len(open_), np.int8)
            undecided = np.arange(len(open_))
            for k in range(self.depth):
                undecided = undecided[length[open_[undecided]] > k]
                if not len(undecided):
                    break
                a, b = text[s[undecided] + k], tokens[p[undecided] + k]
                order[undecided] = np.sign(a - b)
                undecided = undecided[a == b]
            right = order <= 0 if upper else order < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct window, word position in the shard) of each occurrence of each window."""
        lo = self._prefixes(False)
        n = self._prefixes(True) - lo
        return np.repeat(np.arange(len(n)), n), self.origin[self.array[_slots(lo, n)]]

    def covered(self, window: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which words of the shard lie in an occurrence."""
        count = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(count, at, 1)
        np.add.at(count, at + self.test.length[window], -1)
        return np.cumsum(count[:-1]) > 0

    def longest(self, window: np.ndarray, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """For each word of the shard, the words of the longest match from it on that holds a window; a match of fewer words than the longest window is a short item's."""
        found = np.zeros(len(self.test.length), bool)
        found[window] = True
        starts = np.flatnonzero((self.test.window_of >= 0) & found[self.test.window_of])
        count = np.zeros(len(self.test.tokens) + 1, np.int64)
        np.add.at(count, starts, 1)
        np.add.at(count, starts + self.test.length[self.test.window_of[starts]], -1)
        test, _ = _stretches(self.test.tokens, self.test.item_of, np.cumsum(count[:-1]) > 0)
        text, origin = _stretches(self.tokens, np.zeros(len(self.tokens), np.int8), hit)
        far = longest_matches(text, test)
        out = np.zeros(len(self.tokens), np.int64)
        real = (origin >= 0) & (far >= self.depth)
        out[origin[real]] = far[real]
        np.maximum.at(out, at, self.test.length[window])
        return out


def _holders(test: ItemBlock, doc: np.ndarray, window: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Distinct pairs (document, item) as document * items + item."""
    n = len(test.items)
    pairs = np.unique(doc * len(test.length) + window)
    doc, window = pairs // len(test.length), pairs % len(test.length)
    size = test.first[window + 1] - test.first[window]
    upto, out, a = np.cumsum(size), np.zeros(0, np.int64), 0
    while a < len(pairs):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + step, "right")))
        more = np.repeat(doc[a:b], size[a:b]) * n + test.holders[_slots(test.first[window[a:b]], size[a:b])]
        out, a = np.union1d(out, more), b
    return out


def _grouped(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each run of equal values, its start and its end."""
    edge = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(1, np.int64)
    return values[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()


def _search(batches: Iterator[pa.RecordBatch], test: ItemBlock, window: int) -> Iterator[pa.RecordBatch]:
    """Adds what one block of test items finds to the columns n_words, hits (word runs), items and longest."""
    table = np.zeros(1 << 20, bool)
    table[test.vocabulary >> tk.U(44)] = True
    for batch in batches:
        if not batch.num_rows:
            continue
        size, runs = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
        found, best = [set() for _ in range(batch.num_rows)], np.zeros(batch.num_rows, np.int64)
        for words in tk.chunks(batch.column("text"), tk.ALNUM, lower=True, size=SHARD_BYTES):
            n = np.diff(words.first)
            size[words.row : words.row + len(n)] = n
            if not len(test.length) or not len(words.starts):
                continue
            # word ids, with a 0 after each document
            h = tk.word_hashes(words)
            maybe = np.flatnonzero(table[h >> tk.U(44)])
            where = np.minimum(np.searchsorted(test.vocabulary, h[maybe]), len(test.vocabulary) - 1)
            right = test.vocabulary[where] == h[maybe]
            doc = words.doc_of()
            tokens = np.zeros(len(h) + len(n), np.int64)
            tokens[maybe[right] + doc[maybe[right]]] = where[right] + 1
            shard = Shard(tokens, test)
            window_at, at = shard.matches()
            if not len(at):
                continue
            first = words.first[:-1] + np.arange(len(n))
            hit = shard.covered(window_at, at)
            for pair in _holders(test, np.searchsorted(first, at, "right") - 1, window_at).tolist():
                found[words.row + pair // len(test.items)].add(test.items[pair % len(test.items)])
            far = shard.longest(window_at, at, hit)
            places = np.flatnonzero(far)
            np.maximum.at(best, words.row + np.searchsorted(first, places, "right") - 1, far[places])
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            of = np.searchsorted(first, edge[::2], "right") - 1
            spans = np.stack([edge[::2] - first[of], edge[1::2] - edge[::2]], 1).astype(np.int32)
            for row, a, b in zip(*_grouped(words.row + of)):
                runs[row].append(spans[a:b].tobytes())
        if "hits" in batch.schema.names:
            for i, (h, items, far) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), batch.column("longest").to_pylist())):
                runs[i].append(h)
                found[i].update(items)
                best[i] = max(best[i], far)
        out = {"n_words": pa.array(size), "hits": pa.array([b"".join(r) for r in runs], pa.binary()), "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())), "longest": pa.array(best)}
        kept = [c for c in batch.schema.names if c not in out]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out.values()], [*kept, *out])


def _finished(batch: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    """Word runs as counts and text; the document's text stays behind."""
    n_hit, spans = [], []
    for hits in batch.column("hits").to_pylist():
        runs = np.frombuffer(hits, np.int32).reshape(-1, 2)
        if not len(runs):
            n_hit.append(0)
            spans.append("")
            continue
        order = np.argsort(runs[:, 0], kind="stable")
        a, b = runs[order, 0], np.maximum.accumulate((runs[:, 0] + runs[:, 1])[order])
        new = np.r_[True, a[1:] > b[:-1]]
        starts, ends = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]
        n_hit.append(int((ends - starts).sum()))
        spans.append(",".join(f"{s}:{e}" for s, e in zip(starts.tolist(), ends.tolist())))
    flags = pa.array([x > 0 for x in n_hit], pa.bool_())
    columns = [*(batch.column(n) for n in keep), batch.column("n_words"), pa.array(n_hit, pa.int64()), batch.column("items"), batch.column("longest"), pa.array(spans, pa.string()), flags]
    return pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "n_hit", "items", "longest", "spans", "contaminated"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of ``docs``: the ``keep`` columns, n_words, n_hit, items (ids as strings, sorted), longest (words of the longest verbatim match that holds a window), spans
    (word runs that are hit, as ``start:end``) and contaminated.

    ``docs``: text and the ``keep`` columns. ``items``: item_id and text. Texts are lower-cased (A-Z); words are runs of digits, letters and non-ASCII characters. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A word in any occurrence is hit.

    Null or wordless texts have no words and are not contaminated; a null item text has no windows; items that share an id count once. A null
    item_id takes part under the name ``null``. Repeated rows give repeated results, an empty table an empty one.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 32), F.lit(0)).alias("b")).first()
    rounds = max(1, math.ceil(size["b"] / block_bytes))
    # a kept text is the searched one, and goes to Python once
    names = {c: "text" if c == "text" and dict(docs.dtypes)[c] == "string" else f"__keep{i}" for i, c in enumerate(keep)}
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if n != "text"], F.col("text").cast("string").alias("text"))
    fields = ", ".join([*(f"`{n}` {t}" for n, t in out.dtypes), "n_words long, hits binary, items array<string>, longest long"])
    kinds = dict(out.dtypes)
    result = ", ".join([*(f"`{n}` {kinds[n]}" for n in names.values()), "n_words long, n_hit long, items array<string>, longest long, spans string, contaminated boolean"])
    for k in range(rounds):
        part = items if rounds == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == k)
        test = ItemBlock.of([(r["item"], r["text"]) for r in part.toLocalIterator()], window)
        if k < rounds - 1:
            out = out.mapInArrow(lambda it, t=test: _search(it, t, window), fields)
            if (k + 1) % ROUNDS_A_CUT == 0:
                out = cut(out)
        else:
            # the last round also finishes its rows: one Python worker for each task, not two
            out = out.mapInArrow(lambda it, t=test: (_finished(b, list(names.values())) for b in _search(it, t, window)), result)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "n_words", "n_hit", "items", "longest", "spans", "contaminated")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, with their own columns, that hold no window of a test item.

    Null, blank and wordless texts hold none and stay, whatever the items are. Repeated rows stay or go together; a null doc_id is a row like any other. An empty table gives an empty result.
    """
    names = docs.columns
    flagged = contamination(docs, items, window, keep=tuple(names))
    return flagged.filter(~F.col(flagged.columns[-1])).toDF(*names, "__n", "__h", "__i", "__l", "__s", "__c").select(*names)
