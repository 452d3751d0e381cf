"""Export: a volume to coded atoms of all its levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.codec import atoms as codec
from voxspark.functions.addressing import div
from voxspark.model import ATOM, REGION, Dims, q_schedule
from voxspark.operators import pyramid
from voxspark.sources import zarr
from voxspark.sources.archive import Archive
from voxspark.storage import written


def coded_levels(voxels: DataFrame, base_q: list[float]) -> DataFrame:
    """(lod, az, ay, ax, cover, dc, q, payload): each level is made of the one before, written, and coded.

    Only atoms with a voxel other than 0 are rows anywhere: what is empty is never shuffled, coded or stored.
    """
    out = None
    for lod, q in enumerate(base_q):
        if lod:
            voxels = written(pyramid.nonzero_mean(voxels).filter("v <> 0"), f"level-{lod}")
        coded = codec.encode_voxels(voxels, q).select(F.lit(lod).alias("lod"), "*")
        out = coded if out is None else out.unionByName(coded)
    return out


def occupied_chunks(spark: SparkSession, source: str, coarse: int) -> DataFrame:
    """(cz, cy, cx) of the full level's chunks that may hold something, as a coarse level of the source tells.

    One small level is read instead of a look at every chunk. Exact only for sources whose kernel never rounds to 0.
    """
    shape, chunks = zarr.metadata(spark, source)
    if any(c % (1 << coarse) for c in chunks):
        raise ValueError(f"chunks of {chunks} aren't made of whole voxels of level {coarse}")
    voxels = zarr.voxels(spark, source, coarse)
    return voxels.select(*[div(c, n >> coarse).alias(k) for c, n, k in zip("zyx", chunks, ("cz", "cy", "cx"), strict=True)]).distinct()


def zero_regions(spark: SparkSession, dims: Dims, occupied: DataFrame, chunks: list[int]) -> DataFrame:
    """(rz, ry, rx) of the regions that no occupied chunk touches: known to be zero before anything is read."""
    size = ATOM * REGION
    nz, ny, nx = dims.regions()
    grid = spark.range(nz * ny * nx).select(*[F.expr(f"cast({e} AS int)").alias(k) for k, e in (("rz", f"id div {ny * nx}"), ("ry", f"id div {nx} % {ny}"), ("rx", f"id % {nx}"))])
    touched = occupied
    for r, c, n in zip(("rz", "ry", "rx"), ("cz", "cy", "cx"), chunks, strict=True):
        touched = touched.withColumn(r, F.explode(F.sequence(div(F.col(c) * n, size), div(F.col(c) * n + n - 1, size))))
    return grid.join(touched.select("rz", "ry", "rx").distinct(), ["rz", "ry", "rx"], "left_anti")


def to_archive(
    spark: SparkSession, source: str, root: str, volume: str, q0: float = 1.0, falloff: float = 0.6, coarse: int | None = None, alpha: float | None = None
) -> Archive:
    """A chunk tree coded to all levels of a new volume of an archive.

    With ``coarse`` that level of the source says which chunks are read at all, and which regions are known to be zero.
    Levels are means of what isn't 0; with ``alpha`` means moved towards the voxel that stands out. A level's step is
    ``falloff`` times that of the finer one. Each level is written and read again by the next.
    """
    shape, chunks = zarr.metadata(spark, source)
    dims = Dims(shape[2], shape[1], shape[0])
    archive = Archive.create(spark, root, volume, dims, q_schedule(q0, falloff, dims.n_lods))
    occupied = None
    if coarse is not None:
        occupied = written(occupied_chunks(spark, source, coarse), "occupied", narrow=True)
        archive.mark_zero_regions(zero_regions(spark, dims, occupied, chunks))
    voxels = zarr.voxels(spark, source, occupied=occupied)
    for lod in range(dims.n_lods):
        if lod:
            above = dims.lod(lod - 1)
            halved = pyramid.nonzero_mean(voxels) if alpha is None else pyramid.cbox(pyramid.whole_cubes(voxels, above), above, alpha)
            voxels = halved.filter("v <> 0")
        voxels = written(voxels, f"level-{lod}")
        archive.append_atoms(codec.pack(voxels), lod)
    return archive
