"""Vectorised words and rolling hashes over Arrow string buffers.

A column of texts is handled as one byte buffer with document offsets; words are pairs of byte
offsets into it. Nothing is made per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASES = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)
CHUNK_BYTES = 1 << 20

#: word bytes of ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower case
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of consecutive documents: byte ``starts`` and ``ends`` in ``data``; ``first[d]:first[d+1]`` are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    row: int

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, row: int = 0) -> Words:
    w = table[data]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    s[edge] = w[edge]
    e[edge - 1] = w[edge - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), row)


def chunks(column: pa.Array | pa.ChunkedArray, table: np.ndarray, lower: bool, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of whole documents, about ``size`` bytes at a time; a longer document is a chunk of its own."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield words_of(LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at], table, at)
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers are kept for chunks of the usual length; those of longer documents are made each time.
KEPT_POWERS = CHUNK_BYTES + 1


def _make_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if n > KEPT_POWERS:
        return _make_powers(base, n)
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        have = _POWERS[base] = _make_powers(base, min(KEPT_POWERS, 2 * n))
    return have[0][:n], have[1][:n]


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    total, down = _sums(words.data.astype(U) + U(1), BYTE_BASE)
    h = (total[words.ends] - total[words.starts]) * down[words.starts]
    return mixed(h ^ ((words.ends - words.starts).astype(U) << U(40)))


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Hashes of the k words from each word in ``at``."""
    total, down = _sums(hashes, WORD_BASES[base])
    return mixed((total[at + k] - total[at]) * down[at])
