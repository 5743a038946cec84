"""Class-conditional Kneser-Ney models of expressions, in numpy.

An expression (a word of letters and digits) is read byte by byte between two marks. Each
class has counts for the longest context of a byte; shorter contexts have continuation
counts (in how many longer contexts a string was seen) that the classes share. An
expression that neither class has often thus gets much the same probability from both, and
what tells the classes apart is what one of them has more of."""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np

from outvote.llm.text_arrays import Texts, Words, span_hashes

#: Bytes of an expression, the last among them, that a probability looks at.
ORDER = 8
DISCOUNT = 0.8
#: A byte without any context.
UNIFORM = 1 / 256
#: Longer runs are cut into expressions of this length.
LONGEST = 64


#: Letters, digits and all that is not ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BEGIN, END = 0x01, 0x02


#: Bits that are left out of a hash as a key: 48 remain, which a million keys hardly ever share.
SHORTER = np.uint64(16)


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then all second ones, and so on, compressed."""
    return zlib.compress(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes(), 1)


def _from_planes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


@dataclass
class Table:
    """Values by sorted keys; 0 for a key that is not there. Packed, it takes a few bytes a
    key, as it goes to every executor."""

    keys: np.ndarray
    values: np.ndarray

    def packed(self) -> tuple[bytes, bytes, tuple[int, ...]]:
        return _planes(np.diff(self.keys, prepend=np.uint64(0))), _planes(self.values), self.values.shape

    @staticmethod
    def unpacked(steps: bytes, values: bytes, shape: tuple[int, ...]) -> Table:
        keys = np.cumsum(_from_planes(steps, np.uint64), dtype=np.uint64)
        return Table(keys, _from_planes(values, np.uint32).reshape(shape))

    def get(self, wanted: np.ndarray) -> np.ndarray:
        wanted = wanted >> SHORTER
        if not len(self.keys):
            return np.zeros((len(wanted), *self.values.shape[1:]), self.values.dtype)
        order = np.argsort(wanted)  # in order, look-ups stay in the cache
        ordered = wanted[order]
        at = np.minimum(np.searchsorted(self.keys, ordered), len(self.keys) - 1)
        found = np.empty((len(wanted), *self.values.shape[1:]), self.values.dtype)
        hit = self.keys[at] == ordered
        found[order] = np.where(hit if self.values.ndim == 1 else hit[:, None], self.values[at], 0)
        return found


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first row of each, and the sums of its weights (rows x columns)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, int)
    sums = np.add.reduceat(weights[order], new, axis=0) if len(new) else weights[:0]
    return ordered[new], order[new], sums


def _compact(keys: np.ndarray, values: np.ndarray) -> Table:
    """Counts of texts in a bounded sample, as whole numbers. keys: sorted hashes."""
    keys = keys >> SHORTER
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    return Table(keys[new], np.ascontiguousarray(values[new].astype(np.uint32)))


def spans_of(texts: Texts) -> Words:
    """The expressions of each text."""
    inside = INSIDE[texts.data]
    edges = np.zeros(len(inside) + 1, bool)
    edges[texts.bounds] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edges[1:-1]
    finishes[:-1] &= ~inside[1:] | edges[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    pieces = -(-(ends - starts) // LONGEST)
    if (pieces > 1).any():
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + nth * LONGEST
        ends = np.minimum(np.repeat(ends, pieces), starts + LONGEST)
    return Words(starts, ends, np.searchsorted(starts, texts.bounds))


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data[starts[j]:ends[j]] between marks, one after another; and for each byte to be
    predicted its place, its expression and the beginning of that."""
    lengths = ends - starts
    marked = np.cumsum(lengths + 2) - lengths - 2
    word = np.repeat(np.arange(len(starts)), lengths)
    within = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full(int((lengths + 2).sum()), END, np.uint8)
    out[marked] = BEGIN
    out[marked[word] + 1 + within] = data[starts[word] + within]
    word = np.repeat(np.arange(len(starts)), lengths + 1)
    return out, np.arange(len(word)) + word + 1, word, marked[word]


def _bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends


class Models:
    """Two classes over shared backoff counts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, order: int = ORDER):
        """counts: words x 2, how many texts of each class have the word."""
        self.order = order
        data, place, word, start = _marked(*_bytes(words))
        full = np.maximum(start, place - order + 1)
        gram, context = span_hashes(data, full, place + 1), span_hashes(data, full, place)
        keys, first, sums = _summed(gram, counts[word].astype(np.float32))
        self.top = _compact(keys, sums)
        own = np.concatenate((sums, (sums > 0).astype(np.float32)), axis=1)
        keys, _, sums = _summed(context[first], own)
        self.top_context = _compact(keys, sums)
        # every string of up to `order` bytes once; each counts for the string without its first byte
        extended, followed = [], []
        for size in range(2, order + 1):
            held = place - size + 1 >= start
            begin, end = place[held] - size + 1, place[held]
            _, first, _ = _summed(span_hashes(data, begin, end + 1), np.zeros((int(held.sum()), 0), np.float32))
            begin, end = begin[first], end[first]
            extended.append(span_hashes(data, begin + 1, end + 1))
            followed.append(span_hashes(data, begin + 1, end))
        extended, followed = np.concatenate(extended), np.concatenate(followed)
        ones = np.ones((len(extended), 1), np.float32)
        keys, first, sums = _summed(extended, ones)
        self.shared = _compact(keys, sums[:, 0])
        own = np.concatenate((sums, np.ones_like(sums)), axis=1)
        keys, _, sums = _summed(followed[first], own)
        self.shared_context = _compact(keys, sums)

    def packed(self) -> bytes:
        tables = (self.top, self.top_context, self.shared, self.shared_context)
        return pickle.dumps((self.order, [t.packed() for t in tables]))

    @staticmethod
    def unpacked(data: bytes) -> Models:
        made = Models.__new__(Models)
        made.order, tables = pickle.loads(data)
        made.top, made.top_context, made.shared, made.shared_context = (Table.unpacked(*t) for t in tables)
        return made

    def ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P(expression | class 1) - log P(expression | class 0) of data[starts[j]:ends[j]]."""
        if not len(starts):
            return np.zeros(0)
        data, place, word, start = _marked(data, starts, ends)
        backoff = np.full(len(place), UNIFORM)
        for size in range(1, self.order):
            # the longest context has the class counts instead
            held = np.flatnonzero(place - size >= start)
            begin = place[held] - size + 1
            seen = self.shared.get(span_hashes(data, begin, place[held] + 1)).astype(float)
            total, kinds = self.shared_context.get(span_hashes(data, begin, place[held])).T.astype(float)
            known = total > 0
            total = np.where(known, total, 1)
            p = np.maximum(seen - DISCOUNT, 0) / total + DISCOUNT * kinds / total * backoff[held]
            backoff[held] = np.where(known, p, backoff[held])
        full = np.maximum(start, place - self.order + 1)
        seen = self.top.get(span_hashes(data, full, place + 1)).astype(float)
        context = self.top_context.get(span_hashes(data, full, place)).astype(float)
        p = []
        for k in (0, 1):
            total = np.where(context[:, k] > 0, context[:, k], 1)
            own = np.maximum(seen[:, k] - DISCOUNT, 0) / total + DISCOUNT * context[:, 2 + k] / total * backoff
            p.append(np.where(context[:, k] > 0, own, backoff))
        return np.bincount(word, np.log(p[1]) - np.log(p[0]), len(starts))


# --- the same models in parts, for counts that no single task can hold -----------------------

#: Bytes at the end of a context that name its part; strings with shorter contexts are few.
PART_BYTES = 3


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, ...]:
    """Marked bytes; begin, end and expression of the longest string that predicts each byte.
    An expression's ratio is the sum of its strings' ratios."""
    data, place, word, start = _marked(data, starts, ends)
    return data, np.maximum(start, place - order + 1), place + 1, word


@dataclass
class Lookup:
    """Values (keys x columns) by sorted 64-bit keys; 0 for a key that is not there."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Lookup:
        order = np.argsort(keys, kind="stable")
        return Lookup(keys[order], values[order])

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.zeros((len(wanted), self.values.shape[1]), self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return hit, np.where(hit[:, None], self.values[at], 0)


def _continuations(strings: np.ndarray, contexts: np.ndarray, kinds: np.ndarray) -> tuple[Lookup, Lookup]:
    """How many longer strings end in a string, by its key; and a context's sum and kinds."""
    keys, first, sums = _summed(strings, kinds)
    own = np.concatenate((sums, (sums > 0).astype(float)), axis=1)
    above, _, totals = _summed(contexts[first], own)
    return Lookup(keys, sums), Lookup(above, totals)


def short_strings(strings: list[bytes], extended: np.ndarray) -> tuple[Lookup, Lookup]:
    """Shared counts of strings of up to PART_BYTES bytes. extended: strings x models."""
    data, starts, ends = _bytes(strings)
    return _continuations(span_hashes(data, starts, ends), span_hashes(data, starts, ends - 1), extended.astype(float))


def part_ratios(grams: list[bytes], counts: np.ndarray, short: tuple[Lookup, Lookup], model: int, order: int = ORDER) -> np.ndarray:
    """log P(last byte | class 1) - log P(last byte | class 0) of each longest string. grams:
    distinct, with all others whose contexts end alike; counts: grams x 2, 0 if not learnt."""
    data, starts, ends = _bytes(grams)
    lengths = ends - starts
    learnt = np.flatnonzero(counts.any(1))
    strings, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for size in range(PART_BYTES + 2, order + 1):
        rows = learnt[lengths[learnt] >= size]
        begin, end = ends[rows] - size, ends[rows]
        _, first, _ = _summed(span_hashes(data, begin, end), np.zeros((len(rows), 0)))
        strings.append(span_hashes(data, begin[first] + 1, end[first]))
        contexts.append(span_hashes(data, begin[first] + 1, end[first] - 1))
    strings, contexts = np.concatenate(strings), np.concatenate(contexts)
    long = _continuations(strings, contexts, np.ones((len(strings), 1)))
    backoff = np.full(len(grams), UNIFORM)
    for size in range(1, order):
        held = np.flatnonzero(lengths > size)
        begin, end = ends[held] - size, ends[held]
        (seen_in, total_in), k = (short, model) if size <= PART_BYTES else (long, 0)
        seen = seen_in.find(span_hashes(data, begin, end))[1][:, k]
        context = total_in.find(span_hashes(data, begin, end - 1))[1]
        total, kinds = context[:, k], context[:, context.shape[1] // 2 + k]
        known = total > 0
        total = np.where(known, total, 1)
        p = np.maximum(seen - DISCOUNT, 0) / total + DISCOUNT * kinds / total * backoff[held]
        backoff[held] = np.where(known, p, backoff[held])
    _, which = np.unique(span_hashes(data, starts, ends - 1), return_inverse=True)
    p = []
    for k in (0, 1):
        total = np.bincount(which, counts[:, k])[which]
        kinds = np.bincount(which, counts[:, k] > 0)[which]
        divisor = np.where(total > 0, total, 1)
        own = np.maximum(counts[:, k] - DISCOUNT, 0) / divisor + DISCOUNT * kinds / divisor * backoff
        p.append(np.where(total > 0, own, backoff))
    return np.log(p[1]) - np.log(p[0])
