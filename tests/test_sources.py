import json

import pytest

from tests.test_codec import frame, sinusoid
from voxspark.model import Box, Dims
from voxspark.operators import metrics
from voxspark.sources import archive, zarr


@pytest.fixture
def tree(tmp_path):
    v = sinusoid(20, 24, 40)
    v[:10, :, :10] = 0
    meta = {"shape": list(v.shape), "chunks": [10, 12, 10], "dtype": "|u1", "compressor": None, "dimension_separator": "/", "zarr_format": 2}
    (tmp_path / "0").mkdir()
    (tmp_path / "0/.zarray").write_text(json.dumps(meta))
    for z in range(2):
        for y in range(2):
            for x in range(4):
                part = v[z * 10 : z * 10 + 10, y * 12 : y * 12 + 12, x * 10 : x * 10 + 10]
                if part.any():
                    (tmp_path / f"0/{z}/{y}").mkdir(parents=True, exist_ok=True)
                    (tmp_path / f"0/{z}/{y}/{x}").write_bytes(part.tobytes())
    return tmp_path, v


def test_zarr(spark, tree):
    root, v = tree
    assert zarr.metadata(spark, root) == ([20, 24, 40], [10, 12, 10])
    files = zarr.chunk_files(spark, root)
    assert files.count() == 14 and {(r.cz, r.cx) for r in files.collect() if r.cz == 0} == {(0, 1), (0, 2), (0, 3)}
    got = zarr.voxels(spark, str(root))
    assert metrics.differing(got, frame(spark, v).filter("v <> 0")).count() == 0
    chunks = {(r.cz, r.cy, r.cx): bytes(r.bytes) for r in zarr.chunk_bytes(got, [10, 12, 10]).collect()}
    assert chunks == {(r.cz, r.cy, r.cx): bytes(r.bytes) for r in zarr.read_chunks(spark, str(root)).collect()}
    assert zarr.read_chunks(spark, str(root), occupied=spark.createDataFrame([(5, 5, 5)], "cz int, cy int, cx int")).count() == 0
    some = spark.createDataFrame([(0, 0, 1), (5, 5, 5)], "cz int, cy int, cx int")
    assert zarr.read_chunks(spark, str(root), occupied=some).count() == 1


def test_short_chunks_and_bad_metadata(spark, tree):
    root, _ = tree
    path = root / "0/1/1/3"
    path.write_bytes(path.read_bytes()[:700])
    assert zarr.read_chunks(spark, str(root), short="skip").count() == 13
    (r,) = [r for r in zarr.read_chunks(spark, str(root)).collect() if (r.cz, r.cy, r.cx) == (1, 1, 3)]
    assert len(r.bytes) == 1200 and not any(r.bytes[700:])
    with pytest.raises(ValueError, match="pad or skip"):
        zarr.read_chunks(spark, str(root), short="x")
    for change in ({"dtype": "<u2"}, {"compressor": {"id": "zlib"}}, {"dimension_separator": "."}, {"shape": [1, 2]}):
        meta = json.loads((root / "0/.zarray").read_text()) | change
        (root / "1").mkdir(exist_ok=True)
        (root / "1/.zarray").write_text(json.dumps(meta))
        with pytest.raises(ValueError):
            zarr.metadata(spark, root, 1)


def test_raw(spark, tmp_path):
    v = sinusoid(5, 6, 7)
    (tmp_path / "v.raw").write_bytes(v.tobytes())
    assert metrics.differing(zarr.raw(spark, str(tmp_path / "v.raw"), 7, 6, 5), frame(spark, v)).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        zarr.raw(spark, str(tmp_path / "v.raw"), 7, 6, 6)


def test_archive(spark, tmp_path):
    root, dims = str(tmp_path / "a"), Dims(2048, 64, 64)
    a = archive.Archive.create(spark, root, "one", dims, [1.0, 0.01], metadata="notes")
    assert (a.dims, a.n_lods, a.base_q, a.metadata) == (dims, 8, [1.0, 0.05], "notes")
    v = sinusoid(64, 64, 64)
    v[:32, :32, 32:] = 0
    df = frame(spark, v).withColumn("x", __import__("pyspark.sql.functions", fromlist=["col"]).col("x") + 992)
    a.append_box(df, Box(992, 0, 0, 1056, 64, 64), ingest_id=1)
    grid = spark.createDataFrame([(0, 0, 31), (0, 0, 32), (1, 1, 32), (0, 0, 63), (0, 0, 5)], "az int, ay int, ax int")
    regions = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "rz int, ry int, rx int")
    cover = lambda: {r.ax: r.cover for r in a.coverage(grid.filter("az = 0")).collect()}
    assert cover() == {31: 2, 32: 1, 63: 0, 5: 0}
    a.mark_zero_regions(regions)
    assert a.zero_regions().count() == 0
    a.mark_zero_atoms(spark.createDataFrame([(0, 0, 31), (0, 0, 5)], "az int, ay int, ax int"), ingest_id=2)
    assert cover() == {31: 2, 32: 1, 63: 0, 5: 1}
    before = a.read_box(Box(1000, 3, 4, 1050, 60, 40))
    assert before.count() == 50 * 57 * 36
    want = df.filter("x >= 1000 AND x < 1050 AND y >= 3 AND y < 60 AND z >= 4 AND z < 40")
    assert metrics.basket(metrics.paired(want, before)).first().psnr > 27
    a.append_atoms(spark.createDataFrame([(0, 0, 31, bytearray(b"\7" * 32768))], "az int, ay int, ax int, vox binary"), ingest_id=9)
    assert metrics.differing(before, a.read_box(Box(1000, 3, 4, 1050, 60, 40))).count() == 0
    s = a.stats().first()
    assert (s.present, s.zero) == (7, 2) and s.ratio > 5
    assert a.read_box(Box(0, 0, 0, 3, 3, 3)).agg({"v": "max"}).first()[0] == 0
    with pytest.raises(ValueError):
        a.append_box(df, Box(992, 0, 0, 1056, 64, 63))
    with pytest.raises(ValueError, match="no quantiser step"):
        a.append_atoms(grid.selectExpr("*", "cast('' AS binary) vox"), lod=2)
    with pytest.raises(Exception, match="outside the volume"):
        a.append_atoms(spark.createDataFrame([(9, 0, 0, bytearray(32768))], "az int, ay int, ax int, vox binary"))
    with pytest.raises(ValueError):
        archive.Archive(spark, root, "other")
    with pytest.raises(ValueError, match="already"):
        archive.Archive.create(spark, root, "one", dims, [1.0])
    assert {r.kind: r.n for r in a.accounting().collect()} == {"payload": 7, "header": 7}
    (check,) = a.verify(df, 1).collect()
    assert (check.atoms, check.n) == (7, 7 * 32768) and check.psnr > 40
    (some,) = a.verify(df, 3, most=2).collect()
    assert some.atoms <= 2 and some.n == some.atoms * 32768
    with pytest.raises(ValueError):
        archive.Archive.create(spark, root, "two", dims, [1.0], target_ratio=0.5)


def test_zero_region_marks_an_empty_region(spark, tmp_path):
    a = archive.Archive.create(spark, str(tmp_path / "b"), "one", Dims(2048, 64, 64), [1.0])
    a.append_atoms(spark.createDataFrame([(0, 0, 0, bytearray(b"\5" * 32768))], "az int, ay int, ax int, vox binary"))
    a.mark_zero_regions(spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 0, 1)], "rz int, ry int, rx int"))
    grid = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 0, 40)], "az int, ay int, ax int")
    assert {r.ax: r.cover for r in a.coverage(grid).collect()} == {0: 2, 1: 0, 40: 1}
