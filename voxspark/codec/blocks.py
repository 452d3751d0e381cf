"""Blocks of n^3 voxels as NumPy batches: integer DCT, dead-zone quantiser, scan order."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from voxspark.operators.transform import SHIFT, dct_matrix

DEAD, OFFSET = 0.8, 0.2


@lru_cache(4)
def matrix(n: int) -> np.ndarray:
    return np.array([c for _, _, c in dct_matrix(n)], np.float64).reshape(n, n)


@lru_cache(4)
def scan(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raster index by place, band by place, frequency by raster index)."""
    z, y, x = np.indices((n, n, n))
    f = (z + y + x).ravel()
    order = np.lexsort((np.arange(n**3), f))
    return order, np.minimum(f[order] * 8 // (3 * n), 7), f


#: Blocks that are transformed at a time, so that they stay in a core's cache.
NEAR = 4


def _round(values: np.ndarray) -> np.ndarray:
    """Shifted down in place, half up. Products stay below 2^53, so double sums are exact."""
    values += 1 << (SHIFT - 1)
    values *= 1.0 / (1 << SHIFT)
    return np.floor(values, out=values)


def lines(values: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Along x, y, then z."""
    n = len(c)
    out = np.empty(values.shape)
    for at in range(0, len(values), NEAR):
        some = np.ascontiguousarray(values[at : at + NEAR], np.float64)
        some = _round(some.reshape(-1, n) @ c.T).reshape(-1, n, n)
        some = _round(np.matmul(c, some)).reshape(-1, n, n * n)
        out[at : at + NEAR] = _round(np.matmul(c, some)).reshape(-1, n, n, n)
    return out


def forward(blocks: np.ndarray) -> np.ndarray:
    return lines(blocks, matrix(blocks.shape[1])).astype(np.int64)


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs of rows; most are a row or two long."""
    out, size = rows[first], np.diff(np.append(first, len(rows)))
    for k in range(1, int(size.max())):
        on = np.flatnonzero(size > k)
        out[on] += rows[first[on] + k]
    return out


def _planes(atom: np.ndarray, place: np.ndarray, v: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(block and plane, m^2 values) after the passes along x and y, of planes with a voxel that isn't 0.

    Voxels are ordered by block and raster place. Lines and planes without a voxel stay 0 in every pass, so only those
    with one are summed: the same integers as ``forward`` has there.
    """
    c = matrix(n)[:m].T
    key, rows = atom * n**3 + place, v[:, None] * c[place % n]
    for size in (n, n * n):
        first = np.flatnonzero(np.append(True, key[1:] // size != key[:-1] // size))
        rows, key = _round(_sums(rows, first)), key[first]
        if size == n:
            rows = (c[key // n % n][:, :, None] * rows[:, None, :]).reshape(len(key), -1)
    return key // (n * n), rows


def forward_low(atom: np.ndarray, place: np.ndarray, v: np.ndarray, n: int, m: int) -> np.ndarray:
    """The first ``m`` frequencies of every axis, (blocks, m, m, m), of blocks given by their voxels that aren't 0."""
    key, planes = _planes(atom, place, v, n, m)
    cubes = matrix(n)[:m].T[key % n][:, :, None] * planes[:, None, :]
    return _round(np.add.reduceat(cubes, np.flatnonzero(np.append(True, key[1:] // n != key[:-1] // n)))).reshape(-1, m, m, m)


def levels_low(atom: np.ndarray, place: np.ndarray, v: np.ndarray, n: int, m: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``quantize_some`` of ``forward_low``, a block at a time: only sums that come near a level are rounded."""
    key, planes = _planes(atom, place, v, n, m)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] // n != key[:-1] // n, [True]])).tolist()
    c, near = matrix(n)[:m].T[key % n].T, (DEAD * s - 0.5) * (1 << SHIFT) - 1
    cube, size, found = np.empty((m, m * m)), np.empty(m**3), []
    for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        np.matmul(c[:, i:j], planes[i:j], out=cube)
        at = np.flatnonzero(np.abs(cube.ravel(), out=size) >= near)
        _, some, level = quantize_some(_round(cube.ravel()[at])[None], s[at])
        found.append((np.full(len(some), k), at[some], level))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def low_reach(v: np.ndarray, rows: np.ndarray, planes: np.ndarray, n: int, q: float) -> np.ndarray:
    """The L1 frequency from which on a block has no level, by the sum of its voxels' sizes, and the lines and planes
    that hold them.

    A pass multiplies that sum by the largest coefficient of the matrix at most, and rounds by a half.
    """
    most = np.abs(matrix(n)).max() / (1 << SHIFT)
    bound = ((v * most + rows / 2) * most + planes / 2) * most + 0.5
    return np.searchsorted(DEAD * _step(n, q), bound * (1 + 1e-9), "right")


def inverse(coefficients: np.ndarray) -> np.ndarray:
    return lines(coefficients, matrix(coefficients.shape[1]).T).astype(np.int64)


@lru_cache(64)
def _step(n: int, q: float) -> np.ndarray:
    """The step of each L1 frequency."""
    return (1.0 + np.arange(3 * n - 2)) ** 0.65 * q


@lru_cache(64)
def steps(n: int, q: float) -> np.ndarray:
    return _step(n, q)[scan(n)[2]].reshape(n, n, n)


@lru_cache(4)
def ranks(n: int) -> np.ndarray:
    """Place in scan order by raster index."""
    out = np.empty(n**3, np.int64)
    out[scan(n)[0]] = np.arange(n**3)
    return out


def quantize_some(coefficients: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, index, level) of the levels that aren't 0; coefficients and their steps are flat in each block."""
    size = np.abs(coefficients)
    block, index = np.nonzero(size >= DEAD * s)
    size, s = size[block, index], s[index]
    level = np.minimum(np.floor((size - DEAD * s) / s + 1), 32767)
    return block, index, np.where(coefficients[block, index] < 0, -level, level).astype(np.int64)


def quantize(coefficients: np.ndarray, q: float) -> np.ndarray:
    s = steps(coefficients.shape[1], q)
    size = np.abs(coefficients)
    level = np.where(size >= DEAD * s, np.floor((size - DEAD * s) / s + 1), 0)
    return (np.sign(coefficients) * np.minimum(level, 32767)).astype(np.int64)


def dequantize(levels: np.ndarray, q: float, middle: bool = False) -> np.ndarray:
    """Integers in 1/256; or, with ``middle``, the form of masked blocks: 0.8 steps, and 0.4 of one more."""
    s = steps(levels.shape[1], q)
    size = np.abs(levels)
    if middle:
        out = np.rint((size - 1) * s + DEAD * s + 0.4 * s).astype(np.int64)
    else:
        out = (size * np.rint(256 * s).astype(np.int64) + np.rint(256 * OFFSET * s).astype(np.int64) + 128) >> 8
    return np.where(levels == 0, 0, np.sign(levels) * out)


def fill_air(blocks: np.ndarray, sweeps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, dc): air takes the mean of the material, then of its neighbours in the block, some sweeps long."""
    material = blocks != 0
    count = material.reshape(len(blocks), -1).sum(1)
    total = blocks.reshape(len(blocks), -1).sum(1, dtype=np.int64)
    dc = np.where(count > 0, (total + count // 2) // np.maximum(count, 1), 0)
    out = np.where(material, blocks, dc[:, None, None, None]).astype(np.float64)
    n = blocks.shape[1]
    for _ in range(sweeps):
        padded, ones = np.pad(out, ((0, 0), (1, 1), (1, 1), (1, 1))), np.pad(np.ones((n, n, n)), 1)
        total, near = np.zeros_like(out), np.zeros((n, n, n))
        for axis in range(3):
            for shift in (0, 2):
                at = [slice(1, -1)] * 3
                at[axis] = slice(shift, shift + n)
                total += padded[(slice(None), *at)]
                near += ones[tuple(at)]
        out = np.where(material, blocks, total / near)
    return np.floor(out + 0.5).astype(np.int64), dc
