"""Dense 8-bit volumes from files: Zarr v2 chunk trees and raw files, read by Spark's own readers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _small_file(spark: SparkSession, path: str) -> str:
    """A small file's text through Hadoop's file systems; Spark's readers pass over names that start with a dot."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).open(at)
    try:
        return sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def metadata(spark: SparkSession, root: str, level: int = 0) -> tuple[list[int], list[int]]:
    """(shape, chunks) of a level, z first; what isn't plain bytes with a folder for each axis is refused."""
    m = json.loads(_small_file(spark, f"{root}/{level}/.zarray"))
    if len(m.get("shape") or ()) != 3 or len(m.get("chunks") or ()) != 3:
        raise ValueError(f"{root}/{level} isn't a three-dimensional array")
    if "u1" not in (m.get("dtype") or "") or m.get("compressor") is not None or m.get("dimension_separator") != "/":
        raise ValueError(f"{root}/{level} isn't made of plain bytes in a folder for each axis")
    return list(m["shape"]), list(m["chunks"])


def _files(spark: SparkSession, paths: str | list[str], *columns: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").load(paths)
    parts = F.split("path", "/")
    at = [F.element_at(parts, -k).cast("int").alias(c) for k, c in ((3, "cz"), (2, "cy"), (1, "cx"))]
    return files.select(*at, "length", *columns)


def chunk_files(spark: SparkSession, root: str, level: int = 0) -> DataFrame:
    """(cz, cy, cx, length) of the chunks there are. Files are listed, not read."""
    return _files(spark, f"{root}/{level}")


def read_chunks(spark: SparkSession, root: str, level: int = 0, short: str = "pad", occupied: DataFrame | None = None) -> DataFrame:
    """(cz, cy, cx, bytes): missing chunks are no rows; a short one is padded with zeros, or left out with ``skip``.

    With ``occupied`` only those chunks are opened: files are listed, joined, and then read.
    """
    if short not in ("pad", "skip"):
        raise ValueError(f"short is pad or skip, not {short!r}")
    _, chunks = metadata(spark, root, level)
    size = chunks[0] * chunks[1] * chunks[2]
    paths: str | list[str] = f"{root}/{level}"
    if occupied is not None:
        # The names of files to read; Spark's own file index holds them on the driver as well.
        wanted = _files(spark, paths, "path").join(occupied.select("cz", "cy", "cx").distinct(), ["cz", "cy", "cx"], "left_semi")
        paths = [r["path"] for r in wanted.select("path").toLocalIterator()]
    rows = _files(spark, paths, F.col("content").alias("bytes")) if paths else spark.createDataFrame([], "cz int, cy int, cx int, length long, bytes binary")
    if short == "skip":
        rows = rows.filter(F.col("length") >= size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [c[:size].ljust(size, b"\0") for c in b.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("cz", "cy", "cx")), pa.array(whole, pa.binary())], ["cz", "cy", "cx", "bytes"])

    return rows.mapInArrow(run, "cz int, cy int, cx int, bytes binary")


def voxels(spark: SparkSession, root: str, level: int = 0, short: str = "pad", occupied: DataFrame | None = None) -> DataFrame:
    """(z, y, x, v) of what isn't 0, within the array's shape; of occupied chunks alone, where these are given."""
    shape, chunks = metadata(spark, root, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                first = [b.column(k)[i].as_py() * c for k, c in zip(("cz", "cy", "cx"), chunks, strict=True)]
                box = np.frombuffer(b.column("bytes")[i].as_py(), np.uint8).reshape(chunks)
                z, y, x = np.nonzero(box)
                v = box[z, y, x].astype(np.int32)
                at = [(a + f).astype(np.int32) for a, f in zip((z, y, x), first, strict=True)]
                on = np.logical_and.reduce([a < s for a, s in zip(at, shape, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(a[on]) for a in (*at, v)], ["z", "y", "x", "v"])

    return read_chunks(spark, root, level, short, occupied).mapInArrow(run, "z int, y int, x int, v int")


def chunk_bytes(voxel_table: DataFrame, chunks: list[int]) -> DataFrame:
    """(cz, cy, cx, bytes) of the chunks that hold a voxel other than 0, as they would be stored."""
    keys = [F.floor(F.col(c) / n).cast("int").alias(k) for c, k, n in zip("zyx", ("cz", "cy", "cx"), chunks, strict=True)]
    place = (F.col("z") % chunks[0] * chunks[1] + F.col("y") % chunks[1]) * chunks[2] + F.col("x") % chunks[2]

    def one(table: pa.Table) -> pa.Table:
        out = np.zeros(chunks[0] * chunks[1] * chunks[2], np.uint8)
        out[table.column("place").to_numpy()] = table.column("v").to_numpy()
        return pa.table({**{k: table.column(k).slice(0, 1) for k in ("cz", "cy", "cx")}, "bytes": pa.array([out.tobytes()], pa.binary())})

    return voxel_table.filter("v <> 0").select(*keys, place.cast("long").alias("place"), F.col("v").cast("int").alias("v")).groupBy("cz", "cy", "cx").applyInArrow(one, "cz int, cy int, cx int, bytes binary")


def raw(spark: SparkSession, path: str, nx: int, ny: int, nz: int) -> DataFrame:
    """(z, y, x, v) of a headerless file of nx * ny * nz bytes, x fastest; any other length is refused.

    Slices are records of a fixed length to Hadoop's input format: tasks seek to theirs, whatever the file's size.
    """
    length = spark.read.format("binaryFile").load(path).select("length").first()["length"]
    if length != nx * ny * nz:
        raise ValueError(f"{path} has {length} bytes, not {nx * ny * nz}")
    records = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.spark.input.FixedLengthBinaryInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(nx * ny)},
    )
    slices = spark.createDataFrame(records.map(lambda r: (int(r[0]), bytearray(r[1]))), "z int, bytes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = (i.ravel().astype(np.int32) for i in np.indices((ny, nx)))
        for b in batches:
            for z, content in zip(b.column("z").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                v = np.frombuffer(content, np.uint8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ny * nx, z, np.int32)), pa.array(y), pa.array(x), pa.array(v)], ["z", "y", "x", "v"])

    return slices.mapInArrow(run, "z int, y int, x int, v int")
