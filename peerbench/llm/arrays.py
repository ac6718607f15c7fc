"""Words of Arrow text columns as numpy arrays: where they lie, which document has them, their hashes.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return, all of them single bytes in UTF-8, so everything here works on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
BLOCK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places in a word with numbers of their own in the table; later ones are mixed.
_PLACES = 64


@lru_cache(maxsize=1)
def _placed_bytes() -> np.ndarray:
    return mix(mix(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(1 << 50)))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)], dtype=np.uint64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's bounds in them; a null row is empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``BLOCK`` bytes, of one row at least."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of a block of documents, in order. ``ptr[i]:ptr[i + 1]`` are those of document i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: the sum of a random-looking number for each byte at its place, mixed with
        the length. Unlike those of a polynomial, its collisions follow no pattern of letters."""
        out = np.empty(len(self.start), np.uint64)
        length = self.end - self.start
        for lo, hi in blocks(np.r_[0, np.cumsum(length)]):
            n = length[lo:hi]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            value = _placed_bytes()[(np.minimum(within, _PLACES - 1) << 8) | self.data[within + np.repeat(self.start[lo:hi], n)]]
            far = np.flatnonzero(within >= _PLACES)
            if len(far):
                value[far] = mix(value[far] ^ mix(within[far].astype(np.uint64)))
            out[lo:hi] = np.add.reduceat(value, first)
        return mix(out ^ (length.astype(np.uint64) << np.uint64(40)))

    def checks(self, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
        """Another hash, of another kind: a polynomial in ``base`` of a word's bytes, mixed with the length. Some
        pairs of long patterned words share it whatever the base, so it is no hash to stand alone."""
        out = np.empty(len(self.start), np.uint64)
        length = self.end - self.start
        for lo, hi in blocks(np.r_[0, np.cumsum(length)]):
            n = length[lo:hi]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            powers = _powers(base, 1 << max(8, int(n.max()).bit_length()))
            value = (self.data[within + np.repeat(self.start[lo:hi], n)].astype(np.uint64) + np.uint64(1)) * powers[within]
            out[lo:hi] = np.add.reduceat(value, first)
        return mix(out ^ (length.astype(np.uint64) << np.uint64(40)))


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    word = ~space
    start = np.flatnonzero(word & (np.r_[True, space[:-1]] | edge[:-1]))
    end = np.flatnonzero(word & (np.r_[space[1:], True] | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, bounds))


def word_blocks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a text column with their words."""
    data, bounds = text_buffers(column)
    for lo, hi in blocks(bounds):
        part = bounds[lo : hi + 1]
        yield lo, hi, find_words(data[part[0] : part[-1]], part - part[0])


def windows(words: Words, hashes: np.ndarray, width: int, base: int = 0xD1342543DE82EF95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word (counted within its document) of each run of ``width`` words."""
    n = np.maximum(words.count - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return window_hashes(hashes, words.ptr[doc] + pos, width, base), doc, pos


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of the ``width`` hashes from each place in ``at`` on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = out * np.uint64(base) + hashes[at + j]
    return mix(out)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``width`` that begins at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change)[:n] > 0


def occurrence(keys: np.ndarray) -> np.ndarray:
    """How many equal keys come before each one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
    return out
