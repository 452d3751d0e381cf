"""Vectorised words and shingles of Arrow string columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64 bits wide, computed with NumPy over a
whole slice of rows at once; a slice holds a few MB of text, so memory doesn't follow the partition's size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 15

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; ``span_hash`` takes the hash of any span from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_CODES[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    """What brings the difference of two of the first ``n`` prefix sums to the hash of the bytes between them."""
    return _power(_INVERSE, n)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start]
        return mix(raw + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def spans_hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans in order, over SLICE_BYTES of the data at a time: prefix sums take eight bytes a byte."""
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + SLICE_BYTES, "right")))
        out[at:to] = span_hash(prefix_hash(data[low : int(end[to - 1])]), start[at:to] - low, end[at:to] - low)
        at = to
    return out


def ordered(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of 64-bit hashes in order, the hashes in that order, where a new one begins); equal ones by place.

    Upper bits are sorted with the place in the lower ones, as plain integers sort several times faster than places
    do. Should two hashes differ in the lower bits alone, places are sorted.
    """
    low = _U((1 << len(value).bit_length()) - 1)
    key = value & ~low
    key |= np.arange(len(value), dtype=np.uint64)
    key.sort()
    order = (key & low).view(np.int64)
    out, new = value[order], np.ones(len(value), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    key |= low
    if (new[1:] & (key[1:] == key[:-1])).any():
        order = np.argsort(value, kind="stable")
        out = value[order]
        np.not_equal(out[1:], out[:-1], out=new[1:])
    return order, out, new


def distinct(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, the first place of each, which of them each hash is), as ``np.unique`` gives them."""
    order, out, new = ordered(value)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return out[new], order[new], where


_libc = ctypes.CDLL(None)


def tidy() -> None:
    """Gives the system back what freed arrays took: workers live on between tasks, and count with their executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


@dataclass
class Texts:
    """A slice of rows: its bytes, each row's span, and where the rows stand in the whole column."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with 64-bit offsets, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Texts]:
    """Rows in order, in slices of about ``most`` bytes; a longer text is a slice by itself."""
    array = as_array(column)
    n = len(array)
    if not n:
        return
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, n, at + rows)
        yield Texts(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at)
        at = to
    tidy()


def words(texts: Texts, lower: bool = True, gap: np.ndarray = SPACE) -> Words:
    """The runs of bytes that ``gap`` doesn't mark."""
    data = LOWER[texts.data] if lower else texts.data
    solid = ~gap[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[texts.bounds] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(texts.bounds, start, "right") - 1
    return Words(start, end, row, spans_hashed(data, start, end), texts.rows)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``k`` words of a row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _U(0x2545F4914F6CDD1D) + w.hash[j : j + n]
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    return mix(out[at]), at


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of ``k`` words; a row of 1 to k-1 words has them all as its only shingle."""
    value, at = grams(w, k)
    row = w.row[at]
    short = [grams(w, j) for j in range(1, k)]
    n_words = np.bincount(w.row, minlength=w.rows)
    for j, (v, p) in enumerate(short, 1):
        only = n_words[w.row[p]] == j
        value, row = np.concatenate([value, v[only]]), np.concatenate([row, w.row[p[only]]])
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def numbered(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, count) of each row's multiset, ordered by row; an element is a value's upper 48 bits.

    Rows of a slice fit 16 bits, so one sort of plain integers does it.
    """
    key = np.sort((row.astype(np.uint64) << _U(48)) | (value >> _U(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), np.diff(np.append(at, len(new)))


def occurrences(row: np.ndarray, element: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: its n-th copy of an element is an id of its own. (row, id), ordered by row."""
    first = np.cumsum(count) - count
    nth = np.arange(int(count.sum())) - np.repeat(first, count)
    with np.errstate(over="ignore"):
        return np.repeat(row, count), mix(np.repeat(element, count) + nth.astype(np.uint64) * _U(0xA0761D6478BD642F))
