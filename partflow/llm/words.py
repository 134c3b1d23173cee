"""Vectorised word hashing over Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D, which in UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+`` exactly. Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

CHUNK_BYTES = 1 << 20
SLICE_BYTES = 3 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C13)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        back = _U(pow(int(_BASE), -1, 1 << 64))
        _powers = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, _BASE))])
        _inverse = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, back))])
    return _powers, _inverse


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` bytes of text, one row at least."""
    at = batch.schema.get_field_index(text)
    _, offsets = text_bytes(batch.column(at))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_bounds(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one entry more than rows)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right")))
        a, b = starts[lo], ends[hi - 1]
        powers, inverse = _tables(int(b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * powers[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a text column, and for each row the index of its first word (one entry more)."""
    raw, offsets = text_bytes(column)
    starts, ends, rows = word_bounds(raw, offsets)
    return span_hashes(raw, starts, ends), rows


def join_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` consecutive entries; runs are not held back at row ends."""
    if length == 1:
        return h
    out, covered, at = None, 0, 0
    power, step = h, 1
    while True:  # runs of 1, 2, 4, ... entries, put together by the bits of length
        if length & step:
            part = power[at : len(h) - (length - 1) + at] if out is None else power[at : at + len(out)]
            if out is None:
                out = part[: max(0, len(h) - length + 1)]
            else:
                out = mix(out * _U(0x9FB21C651E98DF25) + part[: len(out)])
            at += step
        covered += step
        if at >= length:
            return out
        power = mix(power[: len(power) - step] * _U(0xD6E8FEB86659FD93) + power[step:]) if len(power) > step else power[:0]
        step *= 2


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def row_index(rows: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def run_rank(*keys: np.ndarray) -> np.ndarray:
    """How many earlier positions have the same keys (the last key is the most significant in the sort)."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort(keys)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    out = np.empty(n, np.int64)
    out[order] = rank
    return out
