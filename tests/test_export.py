import json

import numpy as np

from tests.test_codec import frame, sinusoid
from voxspark import __main__ as cli
from voxspark.model import Box, Dims
from voxspark.operators import metrics, pyramid
from voxspark.plans import export
from voxspark.sources.archive import Archive


def write_tree(root, v, chunk, level):
    (root / str(level)).mkdir(parents=True)
    (root / f"{level}/.zarray").write_text(json.dumps({"shape": list(v.shape), "chunks": [chunk] * 3, "dtype": "|u1", "compressor": None, "dimension_separator": "/"}))
    for at in np.ndindex(*(-(-s // chunk) for s in v.shape)):
        part = v[tuple(slice(a * chunk, a * chunk + chunk) for a in at)]
        if part.any():
            path = root / "/".join(map(str, (level, *at)))
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(np.pad(part, [(0, chunk - s) for s in part.shape]).tobytes())


def nonzero_half(v):
    v = np.pad(v, [(0, s % 2) for s in v.shape]).astype(np.int64)
    cubes = v.reshape(v.shape[0] // 2, 2, v.shape[1] // 2, 2, v.shape[2] // 2, 2)
    n, s = (cubes != 0).sum((1, 3, 5)), cubes.sum((1, 3, 5))
    return np.where(n > 0, (s + n // 2) // np.maximum(n, 1), 0).astype(np.uint8)


def test_export_reads_what_is_occupied_and_stores_all_levels(spark, tmp_path, monkeypatch):
    v = np.zeros((40, 33, 1100), np.uint8)
    v[:, :, :48] = sinusoid(40, 33, 48)
    levels = [v]
    while max(levels[-1].shape) > 1 and len(levels) < 8:
        levels.append(nonzero_half(levels[-1]))
    for k in (0, 2):
        write_tree(tmp_path / "src", levels[k], 16, k)
    chunks = export.occupied_chunks(spark, str(tmp_path / "src"), 2)
    assert {(r.cz, r.cy, r.cx) for r in chunks.collect()} == {a for a in np.ndindex(3, 3, 69) if v[tuple(slice(16 * i, 16 * i + 16) for i in a)].any()}
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark)
    cli.main(["export", str(tmp_path / "src"), str(tmp_path / "a"), "vol", "--q", "0.5", "--falloff", "1.0", "--coarse", "2"])
    a = Archive(spark, str(tmp_path / "a"), "vol")
    assert a.dims == Dims(1100, 33, 40) and a.n_lods == 8
    assert [tuple(r) for r in a.zero_regions().collect()] == [(0, 0, 1)]
    for lod, least in ((0, 32), (1, 26), (4, 18)):
        d = a.dims.lod(lod)
        pairs = metrics.paired(frame(spark, levels[lod]), a.read_box(Box(0, 0, 0, d.nx, d.ny, d.nz), lod))
        r = metrics.basket(pairs.filter("a > 0")).first()
        assert pairs.count() == levels[lod].size and r.n == (levels[lod] > 0).sum() and r.psnr > least
    cli.main(["stats", str(tmp_path / "a"), "vol"])
    cli.main(["verify", str(tmp_path / "a"), "vol", str(tmp_path / "src"), "--stride", "1"])
    cli.main(["box", str(tmp_path / "a"), "vol", str(tmp_path / "box"), "0", "0", "0", "5", "6", "7"])
    assert spark.read.parquet(str(tmp_path / "box")).count() == 5 * 6 * 7


def test_cubes_are_filled_with_zeros(spark):
    v = np.random.default_rng(5).integers(0, 256, (5, 4, 3)) * (np.random.default_rng(6).random((5, 4, 3)) < 0.5)
    dims, full = Dims(3, 4, 5), frame(spark, v)
    got = pyramid.cbox(pyramid.whole_cubes(full.filter("v <> 0"), dims), dims).filter("v <> 0")
    assert metrics.differing(got, pyramid.cbox(full, dims).filter("v <> 0")).count() == 0
