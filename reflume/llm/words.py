"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. All
functions work on whole texts. Batches are cut by bytes, so memory does not
follow the number of rows; a single text larger than a cut is handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CUT_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(column: pa.Array, most: int = CUT_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, bytes of the run, offsets within them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1), _BASE)]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each row the range of its words (n + 1 bounds)."""
    return placed_words(data, offsets)[1:]


def placed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where all words begin, and what word_hashes gives."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), bounds
    at = np.flatnonzero(solid)
    firsts = np.searchsorted(at, starts)
    lengths = np.diff(np.append(firsts, len(at)))
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    with np.errstate(over="ignore"):
        terms = _BYTE[_LOWER[data[at]]] * _powers(int(lengths.max()))[place]
        return starts, mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64)), bounds


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, ascending (uint64).

    A row with fewer words than width has its whole sequence as the one
    shingle; a row without words has none.
    """
    for _, data, offsets in cuts(column):
        words, bounds = word_hashes(data, offsets)
        with np.errstate(over="ignore"):
            n = max(0, len(words) - width + 1)
            rolled = np.zeros(n, np.uint64)
            for k in range(width):
                rolled += words[k : k + n] * _powers(width)[k + 1]
            rolled = mix(rolled + np.uint64(width))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= width:
                    yield np.unique(rolled[a : b - width + 1])
                elif b > a:
                    short = np.sum(words[a:b] * _powers(width)[1 : b - a + 1], dtype=np.uint64) + np.uint64(b - a)
                    yield mix(np.atleast_1d(short))
                else:
                    yield np.zeros(0, np.uint64)
