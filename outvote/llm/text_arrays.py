"""Words and hashes of whole Arrow batches of text, as numpy arrays.

A word is a run of characters other than space and the controls 0x09 to 0x0D. These are
single bytes in UTF-8 and never part of another character, so bytes can be searched."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Any odd numbers do; fixed so that hashes agree between runs and machines.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@dataclass
class Texts:
    """The bytes of several texts one after another: text i is data[bounds[i]:bounds[i+1]]."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Word j is data[starts[j]:ends[j]]; those of text i are numbers first[i]:first[i+1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def texts_of(column: pa.Array) -> Texts:
    """A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    return Texts(np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0])


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each, whatever rows they hold."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words_of(texts: Texts) -> Words:
    data, bounds = texts.data, texts.bounds
    inside = ~IS_SPACE[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[edges] = inside[edges]
    edges = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    finishes[edges] = inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finishing steps of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, as many as have been asked for. They stay where
    they were made: a function shipped from a process that has used them takes none along."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self):
        return _Powers, ()

    def to(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
            for k, base in enumerate((BASE, BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                self.tables[k] = np.cumprod(steps)
        return self.tables


_powers = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[j]:ends[j]] from one running sum over the bytes."""
    powers, inverses = _powers.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverses[starts])


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words, and each one's text. A text of fewer words
    (but some) has one run: all of them."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - first[text]
    kept = (place + size <= counts[text]) | (place == 0)
    at, text = np.flatnonzero(kept), text[kept]
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        there = at + j < first[text + 1]
        term = hashes[np.minimum(at + j, len(hashes) - 1)] * np.uint64(pow(BASE, 2 * j + 3, 1 << 64))
        total += np.where(there, term, np.uint64(0))
    return mix(total), text


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte, with the total at the end."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total
