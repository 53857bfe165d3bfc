"""Word shingles of many texts at once, as sorted 64-bit hashes.

A batch's texts stay one UTF-8 buffer. Words are found by a white-space mask, hashed by
differences of a running polynomial sum, and combined into shingles; everything runs over
the buffer, nothing per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=_U))
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(n, b, _U)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


@dataclass
class Words:
    """Hashes of all words of a batch, in order; ``doc`` is the row of each."""

    hash: np.ndarray
    doc: np.ndarray
    rows: int


def words_of(column: pa.Array) -> Words:
    """Words are runs of anything but ASCII white space; null texts have none."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        return Words(np.zeros(0, _U), np.zeros(0, np.int64), len(column))
    space = _SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True  # texts meet here
    first = ~space
    first[1:] &= space[:-1] | cut[1:n]
    last = ~space
    last[:-1] &= space[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(_LETTER[raw] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))
    return Words(h, np.searchsorted(offsets, start, "right") - 1, len(column))


@dataclass
class Sets:
    """Distinct shingles of each row: sorted by row, then hash. ``count`` per row."""

    hash: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    def row(self, i: int) -> np.ndarray:
        at = int(self.count[:i].sum())
        return self.hash[at : at + int(self.count[i])]


def shingle_sets(column: pa.Array, size: int) -> Sets:
    """Texts of fewer than ``size`` words are one shingle, of all their words; empty ones none."""
    w = words_of(column)
    n = np.bincount(w.doc, minlength=w.rows)
    h, doc = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    if len(w.hash) >= size:
        x = w.hash[: len(w.hash) - size + 1].copy()
        for i in range(1, size):
            x = x * _U(_BASE) + w.hash[i : len(w.hash) - size + 1 + i]
        inside = w.doc[: len(x)] == w.doc[size - 1 :]
        h.append(mix(x[inside]))
        doc.append(w.doc[: len(x)][inside])
    first = np.cumsum(n) - n
    for k in range(1, size):
        rows = np.flatnonzero(n == k)
        x = np.full(len(rows), k, _U)
        for i in range(k):
            x = x * _U(_BASE) + w.hash[first[rows] + i] if len(rows) else x
        h.append(mix(x ^ _U(0xA5A5A5A5A5A5A5A5)))
        doc.append(rows)
    hs, ds = np.concatenate(h), np.concatenate(doc)
    order = np.argsort(hs)
    order = order[np.argsort(ds[order].astype(np.int16 if w.rows < 32768 else np.int64), kind="stable")]
    hs, ds = hs[order], ds[order]
    fresh = np.ones(len(hs), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    hs, ds = hs[fresh], ds[fresh]
    return Sets(hs, ds, np.bincount(ds, minlength=w.rows))


def sums_by_run(values: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of values whose run numbers (ascending, below n) are equal."""
    out = np.zeros(n, _U)
    if len(run):
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        out[run[starts]] = np.add.reduceat(values, starts)
    return out
