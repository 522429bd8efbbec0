"""Words and byte ranges of many texts as flat numpy arrays.

A range of bytes has a 64-bit hash that takes two prefix sums to read: bytes
become random 64-bit values, weighted by powers of an odd multiplier,
summed with wrap-around; the difference of two sums divided by the power at
the start depends on the bytes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_R = 0x9E3779B97F4A7C15
_INVERSE = pow(_R, -1, 1 << 64)
_TABLE = np.random.default_rng(20240611).integers(1, 1 << 64, 256, dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        steps = np.full(n, _R, U)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = _INVERSE
        _inverses = np.cumprod(steps)


def forget() -> None:
    """Let go of the powers, which are as many as the longest texts that a worker has met; they are made again when asked for."""
    global _powers, _inverses
    _powers, _inverses = np.ones(1, U), np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of each value over all bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Weighted prefix sums of 64-bit values, one longer than they are."""
    _grow(len(values) + 1)
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * _powers[: len(values)], out=out[1:])
    return out


def prefix_bytes(data: np.ndarray) -> np.ndarray:
    return prefix(_TABLE[data])


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges from ``start`` to ``end`` (not included)."""
    return mix((sums[end] - sums[start]) * _inverses[start])


def grams(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ranges of length ``n``."""
    if len(sums) <= n:
        return np.empty(0, U)
    return mix((sums[n:] - sums[:-n]) * _inverses[: len(sums) - n])


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges that are read once, such as words and lines.

    Eight bytes at a time are mixed with their place in the range before they
    are added up: unlike the sums of ``prefix``, whose ranges of a thousand
    bytes and more can be made to meet, no two texts are known to collide.
    """
    size = (end - start).astype(np.int64)
    blocks = (size + 7) // 8
    ends = np.cumsum(blocks)
    owner = np.repeat(np.arange(len(size)), blocks)
    place = np.arange(len(owner)) - np.repeat(ends - blocks, blocks)
    at = start[owner] + 8 * place
    left = size[owner] - 8 * place
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    value = np.zeros(len(owner), U)
    for i in range(8):
        value |= np.where(left > i, padded[at + i], 0).astype(U) << U(8 * i)
    mixed = mix(mix(place.astype(U) + U(_R)) ^ mix(value + U(1)))
    sums = np.zeros(len(size), U)
    filled = np.flatnonzero(blocks)
    if len(filled):
        sums[filled] = np.add.reduceat(mixed, (ends - blocks)[filled])
    return mix(sums + size.astype(U) * U(_R))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and the offsets of its rows."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Start, end, document and hash of each word ``[^\\x20\\x09-\\x0D]+`` of some texts."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = joined(column)
        if lower:
            self.data = LOWER[self.data]
        self.docs = len(column)
        inside = ~SPACE[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        borders = self.offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(self.data))]
        first[borders] = inside[borders]
        last[borders - 1] = inside[borders - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.hash = hashed(self.data, self.start, self.end)

    def count(self) -> np.ndarray:
        """Words of each document."""
        return np.bincount(self.doc, minlength=self.docs).astype(np.int64)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def coded(column: pa.Array, inside: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct runs of the bytes marked in ``inside`` (by byte value), compared as they are; each run's number among them, and its text."""
    data, offsets = joined(column)
    within = inside[data]
    first = within.copy()
    first[1:] &= ~within[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < len(data)]
    first[borders] = within[borders]
    start = np.flatnonzero(first)
    last = within.copy()
    last[:-1] &= ~within[1:]
    borders = borders[borders > 0]
    last[borders - 1] = within[borders - 1]
    # Without what lies between them, runs lie one after the other; counted by run, as numbers of all bytes take eight times the text.
    kept = data[within]
    place = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - start, out=place[1:])
    if lower:
        kept = LOWER[kept]
    runs_of = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(place), pa.py_buffer(kept)).dictionary_encode()
    return runs_of.dictionary, runs_of.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(offsets, start, "right") - 1


def total(doc: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
    """Integer sums of ``values`` by document."""
    return np.bincount(doc, weights=values, minlength=docs).astype(np.int64)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    if not len(ordered):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where one of each stands, and each value's number among them."""
    order = np.argsort(values)
    ordered = values[order]
    begin = runs(ordered)
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(values))))
    return ordered[begin], order[begin], inverse
