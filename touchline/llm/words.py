"""Bytes, words and hashes of Arrow text columns, as whole numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. Work goes in
slices of bounded size, so that memory follows the slice and not the batch or
the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2**64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, dtype=U64), np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers = tuple(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row starts; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if not len(at):
        at = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[filled[1:] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; equal bytes give equal hashes."""
    forward, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    values = (LOWER[data] if lower else data).astype(U64)
    values += U64(1)
    values *= forward[: len(data)]
    np.cumsum(values, out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and where each row's words start.

    A row longer than a slice is cut at spaces, so one huge document needs no
    more working memory than a slice and its longest word.
    """
    n = len(offsets) - 1
    if n == 1 and offsets[1] - offsets[0] > 2 * SLICE_BYTES:
        parts, at, end = [], 0, len(data)
        while at < end:
            cut = min(end, at + SLICE_BYTES)
            while cut < end:
                gap = np.flatnonzero(_SPACE[data[cut : cut + SLICE_BYTES]])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut = min(end, cut + SLICE_BYTES)
            part = data[at:cut]
            starts, ends = spans(part, np.array([0, len(part)]))
            parts.append(hash_spans(part, starts, ends, lower))
            at = cut
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    if not len(data):
        return np.zeros(0, dtype=U64), np.zeros(n + 1, dtype=np.int64)
    starts, ends = spans(data, offsets)
    return hash_spans(data, starts, ends, lower), np.searchsorted(starts, offsets)


def word_slices(column: pa.Array, lower: bool = True):
    """(first row, end row, word hashes, word offsets) for slice after slice of a column."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        yield first, last, *hashed_words(data[at[0] : at[-1]], at - at[0], lower)
