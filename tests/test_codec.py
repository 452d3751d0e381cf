import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxspark.codec import atoms, blocks, masked, rangecoder
from voxspark.codec.rangecoder import decode_levels, encode_levels
from voxspark.model import Box, Dims, checked_q, q_schedule
from voxspark.operators import coverage, metrics


def sinusoid(nz, ny, nx):
    z, y, x = np.indices((nz, ny, nx))
    return (128 + 60 * np.sin(0.06 * x) + 40 * np.cos(0.05 * y) + 20 * np.sin(0.07 * z)).astype(np.uint8)


def frame(spark, v):
    z, y, x = (i.ravel() for i in np.indices(v.shape))
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"z": z.astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": v.ravel().astype(np.int32)}))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(-40, 40), st.sampled_from([32767, -32767, 13, -13, 14])), min_size=1, max_size=300))
def test_levels_round_trip(levels):
    levels = np.array(levels)
    bands = np.arange(len(levels)) * 8 // len(levels)
    assert (decode_levels(encode_levels(levels, bands), bands) == levels).all()


def plain_coder(levels, bands):
    """The public range coder written out bit by bit, with the byte that a carry may change and its 255s kept apart."""
    low, width, cache, held, out = 0, 0xFFFFFFFF, 0, 1, []

    def shift():
        nonlocal low, cache, held
        if low < 0xFF000000 or low >= 1 << 32:
            out.extend([(cache + (low >> 32)) % 256] + [(255 + (low >> 32)) % 256] * (held - 1))
            cache, held = low >> 24 & 255, 0
        held += 1
        low = low << 8 & 0xFFFFFFFF

    def put(bit, model=None, i=0):
        nonlocal low, width
        part = width >> 1 if model is None else width * model[i] >> 12
        if model is None:
            low, width = low + bit * part, part
        else:
            low, width = (low + part, width - part) if bit else (low, part)
            model[i] += -(model[i] >> 5) if bit else (4096 - model[i]) >> 5
        while width < 1 << 24:
            shift()
            width = width << 8 & 0xFFFFFFFF

    seen, more = [2048] * 8, [2048] * 12
    end = max([0, *(i + 1 for i, v in enumerate(levels) if v)])
    for k in reversed(range(len(levels).bit_length())):
        put(end >> k & 1)
    for v, b in zip(levels[:end], bands, strict=False):
        put(int(v != 0), seen, b)
        if v:
            rest = abs(v) - 1
            for k in range(12):
                put(int(rest > k), more, k)
                if rest <= k:
                    break
            else:
                text = bin(rest - 11 + 1)[2:]
                for c in "1" * (len(text) - 1) + "0" + text[1:]:
                    put(int(c))
            put(int(v < 0))
    for _ in range(5):
        shift()
    return bytes(out)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(-40, 40), st.sampled_from([32767, -32767, 12, 13, -13, 14])), min_size=1, max_size=200))
def test_bytes_are_those_of_a_second_coder(levels):
    bands = [i * 8 // len(levels) for i in range(len(levels))]
    assert encode_levels(np.array(levels), np.array(bands)) == plain_coder(levels, bands)


def test_bytes_worked_out_by_hand():
    # The end of one level is 1 in one plain bit: the upper half of the range. 0 of 1 level: the lower half.
    assert encode_levels(np.array([0]), np.array([0])) == bytes(5)
    # low = 0x7FFFFFFF after the end; significance halves the range and adds 0x3FFFFFFF; a size of one and a sign of plus add nothing.
    assert encode_levels(np.array([1]), np.array([0])) == bytes([0, 0xBF, 0xFF, 0xFF, 0xFE])


def test_coded_atoms_hold_the_second_coder_s_bytes(spark):
    v = sinusoid(32, 32, 64)
    order, bands, _ = blocks.scan(32)
    for r in atoms.encode(atoms.pack(frame(spark, v)), 8.0).collect():
        vox = v[:, :, r.ax * 32 : r.ax * 32 + 32].astype(np.int64)
        dc = int((vox.sum() + 16384) // 32768)
        levels = blocks.quantize(blocks.forward((vox - dc)[None]), 8.0).ravel()[order]
        assert r.dc == dc and bytes(r.payload) == plain_coder(levels.tolist(), bands.tolist())


def test_atoms_of_few_voxels_have_the_payloads_of_filled_ones():
    r = np.random.default_rng(7)
    vox = np.zeros((30, 32768), np.uint8)
    for k, v in enumerate(vox):
        at = r.choice(32768, min(3 * k * k // 2, 32768), replace=False)
        v[at] = r.choice([1, 60, 255], len(at))
    for q in (0.05, 2.0, 40.0):
        dc, _, payload = atoms.code(vox.reshape(-1, 32, 32, 32), q)
        atom, place = np.nonzero(vox)
        cells = place * 256 + vox[atom, place]
        mixed = np.lexsort((r.random(len(cells)), atom))
        for own in (cells, cells[mixed]):
            got = atoms.code_cells(own, np.bincount(atom, minlength=len(vox)), q)
            assert (got[0] == dc).all() and got[1] == payload


def test_blocks_are_coded_side_by_side(monkeypatch):
    """Blocks of all sizes, also empty ones, in parts of some blocks and in steps that end within a block."""
    r, n = np.random.default_rng(10), 600
    bands = np.arange(n) * 8 // n
    levels = np.where(r.random((60, n)) < r.choice([0, 0.002, 0.05, 0.9], (60, 1)), r.integers(-3, 4, (60, n)) * r.choice([1, 1, 1, 9, 5000], (60, n)), 0)
    block, place = np.nonzero(levels)
    want = [plain_coder(v.tolist(), bands.tolist()) for v in levels]
    for bits, modelled, steps, alone in ((1 << 24, 1 << 20, 512, 100), (9000, 2500, 100, 0), (9000, 2500, 7, 1 << 20)):
        for k, v in (("BITS", bits), ("MODELLED", modelled), ("STEPS", steps), ("ALONE", alone)):
            monkeypatch.setattr(rangecoder, k, v)
        assert rangecoder.encode_blocks((levels != 0).sum(1), place, levels[block, place], n, bands) == want


def test_atoms_of_some_voxels_are_coded_by_the_hundred():
    r, n = np.random.default_rng(11), 3000
    cells = np.concatenate([r.choice(32768, 8, replace=False) for _ in range(n)]) * 256 + r.integers(1, 51, 8 * n) * 5
    began = time.process_time()
    dc, payload = atoms.code_cells(cells, np.full(n, 8), 2.0)
    seconds = time.process_time() - began
    some = slice(0, 8 * 5)
    vox = np.zeros((5, 32768), np.uint8)
    vox[np.arange(40) // 8, cells[some] >> 8] = cells[some] & 255
    assert payload[:5] == atoms.code(vox.reshape(-1, 32, 32, 32), 2.0)[2]
    # A bit at a time in each atom, with all sums rounded, they took 1.3 ms each.
    assert len(payload) == n and seconds < 0.001 * n


def test_voxels_are_coded_like_packed_atoms(spark):
    v = sinusoid(40, 70, 50)
    v[np.random.default_rng(8).random(v.shape) < 0.99] = 0
    rows = [sorted((r.az, r.ay, r.ax, r.cover, r.dc, r.q, bytes(r.payload)) for r in df.collect()) for df in (atoms.encode_voxels(frame(spark, v), 1.0), atoms.encode(atoms.pack(frame(spark, v)), 1.0))]
    assert rows[0] == rows[1] and len(rows[0]) == 12
    with pytest.raises(ValueError, match="step"):
        atoms.encode_voxels(frame(spark, v), None)


def test_atoms_of_one_voxel_are_coded_by_the_thousand():
    r, n = np.random.default_rng(9), 100_000
    began = time.process_time()
    _, payload = atoms.code_cells(r.integers(0, 32768, n) * 256 + r.integers(1, 51, n) * 5, np.ones(n, np.int64), 2.0)
    # Filled, transformed and coded voxel by voxel they took minutes.
    assert len(payload) == n and time.process_time() - began < 30


def test_odd_axes_count_their_last_voxel_twice(spark):
    from voxspark.operators import pyramid

    v = np.random.default_rng(4).integers(0, 256, (5, 6, 7))
    twice = np.pad(v, ((0, 1), (0, 0), (0, 1)), mode="edge").reshape(3, 2, 3, 2, 4, 2).transpose(0, 2, 4, 1, 3, 5).reshape(3, 3, 4, 8)
    dims = Dims(7, 6, 5)
    got = {(r.z, r.y, r.x): r.v for r in pyramid.box(frame(spark, v), dims).collect()}
    assert all(got[k] == int(twice[k].sum() / 8 + 0.5) for k in np.ndindex(3, 3, 4))
    for alpha in (0.0, 0.25, 1.0):
        got = {(r.z, r.y, r.x): r.v for r in pyramid.cbox(frame(spark, v), dims, alpha).collect()}
        for k in np.ndindex(3, 3, 4):
            mean = twice[k].mean()
            far = twice[k][np.argmax(np.abs(twice[k] - mean))]
            assert got[k] == int(np.clip(np.floor(mean + alpha * (far - mean) + 0.5), 0, 255))


def test_cut_payloads_read_as_zeros():
    bands = np.zeros(100, np.int64)
    data = encode_levels(np.arange(100) - 50, bands)
    assert len(decode_levels(data[:5], bands)) == 100 and len(decode_levels(b"", bands)) == 100


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(0, 1))
def test_masks_round_trip(seed, share):
    air = np.random.default_rng(seed).random((6, 5, 7)) < share
    assert (masked.decode_mask(masked.encode_mask(air), air.shape) == air).all()


def test_transform_is_nearly_its_inverse():
    v = np.random.default_rng(0).integers(-128, 128, (3, 32, 32, 32))
    err = blocks.inverse(blocks.forward(v)) - v
    assert abs(err).max() <= 4 and np.sqrt((err**2).mean()) < 0.8


def test_quality_floors_and_contents(spark):
    v = sinusoid(64, 64, 64)
    coded = atoms.encode(atoms.pack(frame(spark, v)), 1.0)
    assert coded.count() == 8
    pairs = metrics.paired(frame(spark, v), atoms.unpack(atoms.decode(coded)))
    assert metrics.basket(pairs).first().psnr > 45
    flat = np.full((32, 32, 32), 255, np.uint8)
    assert metrics.basket(metrics.paired(frame(spark, flat), atoms.unpack(atoms.decode(atoms.encode(atoms.pack(frame(spark, flat)), 1.0))))).first().psnr > 40
    zero = spark.createDataFrame([(0, 0, 0, bytearray(32768))], "az int, ay int, ax int, vox binary")
    (r,) = atoms.encode(zero, 1.0).collect()
    assert (r.cover, r.payload) == (1, None)
    assert atoms.decode(atoms.encode(zero, 1.0)).first().vox == bytes(32768)
    with pytest.raises(ValueError, match="step"):
        atoms.encode(zero, None)


def test_boxes_are_what_atoms_hold(spark):
    v = sinusoid(40, 70, 50)
    coded = atoms.encode(atoms.pack(frame(spark, v)), 1.0).persist()
    box = Box(7, 30, 5, 49, 69, 40)
    got = atoms.decode_box(coded, box)
    want = coverage.crop(atoms.unpack(atoms.decode(coded)), box)
    assert got.count() == 42 * 39 * 35 and metrics.differing(got, want).count() == 0


def test_rates_fall_as_steps_grow(spark):
    rows = sorted(atoms.rates(atoms.pack(frame(spark, sinusoid(32, 32, 64))), [0.5, 2.0, 8.0]).collect())
    assert rows[0].bytes > rows[1].bytes > rows[2].bytes and rows[0].sse < rows[1].sse < rows[2].sse


def test_masked_blocks_keep_air(spark):
    v = sinusoid(32, 16, 16)
    v[np.random.default_rng(2).random(v.shape) < 0.4] = 0
    rebuilt = atoms.unpack(masked.decode(masked.encode(atoms.pack(frame(spark, v), 16), 2.0)), 16)
    pairs = metrics.paired(frame(spark, v), rebuilt)
    m = metrics.mask_fidelity(pairs).first()
    assert (m.leaks, m.losses) == (0, 0) and metrics.basket(pairs.filter("a <> 0")).first().psnr > 30


def test_model():
    d = Dims(97, 131, 193)
    assert d.lod(1) == Dims(49, 66, 97) and d.n_lods == 8 and d.atoms() == (7, 5, 4) and Dims(1, 1, 1).n_lods == 1
    for bad in ((0, 1, 1), (1, 1, (1 << 20) + 1)):
        with pytest.raises(ValueError):
            Dims(*bad)
    with pytest.raises(ValueError):
        Box(0, 0, 0, 98, 1, 1).within(d)
    assert (checked_q(0), checked_q(9e9)) == (0.05, 4096.0)
    assert q_schedule(0.2, 0.4, 4) == [0.2, pytest.approx(0.08), 0.05, 0.05]
