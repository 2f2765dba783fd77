"""Vectorised work on the UTF-8 bytes of an Arrow string column.

A batch's texts lie in one buffer, so words, n-grams and hashes are found for all rows at once in numpy, without a
Python object per word. Whole texts are worked on; ``slices`` only bounds how many rows one step holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_M1, _M2, _R = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letters: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = LETTER[ord("A"):ord("Z") + 1] = True
LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0"):ord("9") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single row that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters."""
    out = _LOWER[data]
    if len(out) > 1:
        nxt = out[1:]
        up = (out[:-1] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
        nxt[up] += 0x20
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask``, which also end where a row ends."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(mask)]
    begin[edges] = mask[edges]
    starts = np.flatnonzero(begin)
    stop = np.append(~mask, True)
    stop[edges] = True
    bounds = np.flatnonzero(stop)
    ends = bounds[np.searchsorted(bounds, starts, "right")]
    return starts, ends


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each position."""
    return np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; the spans don't overlap and ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    np.add.at(inside, ends, -1)
    keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = np.full(int(lens.max()), _R)
    power[0] = _U(1)
    power = np.multiply.accumulate(power)
    v = (data[keep].astype(np.uint64) + _U(1)) * power[pos]
    return mix(np.add.reduceat(v, first) + lens.astype(np.uint64) * _M2)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each maximal run of bytes that are not ASCII white space."""
    starts, ends = runs(~SPACE[data], offsets)
    return span_hashes(data, starts, ends), rows_of(starts, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word ``k``-grams, sorted by row: (hash, row offsets).

    A row with fewer than ``k`` words has all its words as its only shingle; a row without words has none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    size = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(n_rows), size)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    width = np.minimum(count, k)[row]
    h = np.zeros(len(row), np.uint64)
    for j in range(k):
        part = hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] if len(hashes) else h
        h = np.where(j < width, mix(h * _R + part), h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])
