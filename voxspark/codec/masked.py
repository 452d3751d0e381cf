"""Masked blocks: air is filled before the transform and forced back to 0, its mask coded beside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxspark.codec import blocks as B
from voxspark.codec.rangecoder import HALF, Decoder, Encoder, decode_levels, encode_blocks
from voxspark.model import BLOCK

KEY = ["az", "ay", "ax"]
#: Blocks that are worked on at a time.
BATCH = 256


def _contexts(air: np.ndarray) -> np.ndarray:
    """4, 2 and 1 for the neighbours before in z, y and x that are air."""
    ctx = np.zeros(air.shape, np.int64)
    ctx[1:] += 4 * air[:-1]
    ctx[:, 1:] += 2 * air[:, :-1]
    ctx[:, :, 1:] += air[:, :, :-1]
    return ctx


def encode_mask(air: np.ndarray) -> bytes:
    e, p = Encoder(), [HALF] * 8
    for a, c in zip(air.ravel().tolist(), _contexts(air.astype(np.int64)).ravel().tolist(), strict=True):
        e.bit(p, c, int(a))
    return e.finish()


def decode_mask(data: bytes, shape: tuple[int, int, int]) -> np.ndarray:
    d, p = Decoder(data), [HALF] * 8
    out = np.zeros(shape, np.int64)
    for z in range(shape[0]):
        for y in range(shape[1]):
            for x in range(shape[2]):
                c = 4 * (z and out[z - 1, y, x]) + 2 * (y and out[z, y - 1, x]) + (x and out[z, y, x - 1])
                out[z, y, x] = d.bit(p, int(c))
    return out.astype(bool)


def encode(blocks: DataFrame, q: float, n: int = BLOCK) -> DataFrame:
    """(az, ay, ax, dc, q, mask, payload) of blocks (az, ay, ax, vox) that hold material."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bands, _ = B.scan(n)
        for b in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
            vox = np.stack([np.frombuffer(v, np.uint8) for v in b.column("vox").to_pylist()]).reshape(-1, n, n, n)
            filled, dc = B.fill_air(vox)
            levels = B.quantize(B.forward(filled - dc[:, None, None, None]), q)
            flat = levels.reshape(len(vox), -1)[:, order]
            block, place = np.nonzero(flat)
            payload = encode_blocks(np.bincount(block, minlength=len(vox)), place, flat[block, place], n**3, bands)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array(dc.astype(np.int32)), pa.array(np.full(len(vox), q)), pa.array([encode_mask(v == 0) for v in vox]), pa.array(payload)], [*KEY, "dc", "q", "mask", "payload"])

    return blocks.select(*KEY, "vox").mapInArrow(run, "az int, ay int, ax int, dc int, q double, mask binary, payload binary")


def decode(coded: DataFrame, n: int = BLOCK) -> DataFrame:
    """(az, ay, ax, vox): air is exactly 0, material at least 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bands, _ = B.scan(n)
        for b in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
            out = []
            for mask, payload, dc, q in zip(*(b.column(c).to_pylist() for c in ("mask", "payload", "dc", "q")), strict=True):
                levels = np.zeros(n**3, np.int64)
                levels[order] = decode_levels(payload, bands)
                v = B.inverse(B.dequantize(levels.reshape(1, n, n, n), q, middle=True))[0] + dc
                out.append(np.where(decode_mask(mask, (n, n, n)), 0, np.clip(v, 1, 255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array(out, pa.binary())], [*KEY, "vox"])

    return coded.mapInArrow(run, "az int, ay int, ax int, vox binary")
