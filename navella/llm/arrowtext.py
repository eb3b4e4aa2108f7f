"""Vectorised text kernels over Arrow string columns, shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of many documents at once, so no Python object is made per word.
Documents are handled in slices of about ``SLICE_BYTES`` to keep the numpy temporaries small whatever the
Arrow batch holds. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads 64-bit values evenly."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_ODD = int(_BASE) | 1
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, of at least n entries."""
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            p = np.full(m, base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, raw


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most limit bytes together, or of one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)


def word_spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in b, and the number of words before each document
    (one entry more than documents). off starts at 0 and ends at len(b)."""
    ink = ~((b == 32) | ((b >= 9) & (b <= 13)))
    first = np.zeros(len(b) + 1, bool)
    first[off] = True
    before = np.empty(len(b), bool)
    before[:1] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | first[:-1]))
    after = np.empty(len(b), bool)
    after[-1:] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over mixed bytes before each place, from which span_hashes takes its hashes."""
    power, _ = _power_tables(len(b) + 1)
    c = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * power[: len(b)], out=c[1:])
    return c


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span. sums: prefix_sums(b), where they serve several calls."""
    c = prefix_sums(b) if sums is None else sums
    _, inverse = _power_tables(len(b) + 1)
    return mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(_U))


class HashTable:
    """Values by 64-bit hashed keys: a slot for most keys, the others in a sorted list."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 6).bit_length())
        self.mask = _U((1 << bits) - 1)
        slot = (keys & self.mask).astype(np.int64)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[slot] = np.arange(1, len(keys) + 1)  # the last of a slot stays
        self.keys, self.values = np.append(_U(0), keys), np.append(0.0, values)
        lost = np.flatnonzero(self.slot[slot] != np.arange(1, len(keys) + 1))
        lost = lost[np.argsort(keys[lost])]
        self.lost_keys, self.lost_values = keys[lost], values[lost]

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        i = self.slot[keys & self.mask]
        out = self.values[i]
        odd = np.flatnonzero((self.keys[i] != keys) | (i == 0))
        found = np.full(len(odd), default)
        if len(self.lost_keys):
            k = keys[odd]
            at = np.minimum(np.searchsorted(self.lost_keys, k), len(self.lost_keys) - 1)
            found = np.where(self.lost_keys[at] == k, self.lost_values[at], default)
        out[odd] = found
        return out


def word_hashes(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each document."""
    starts, ends, at = word_spans(b, off)
    return span_hashes(b, starts, ends), at


def each_slice(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets from 0) of each slice of a string column."""
    off, raw = utf8(column)
    for i, j in slices(off, limit):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
