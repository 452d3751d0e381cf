"""Three-valued coverage: what is absent, known to be zero, or present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.functions.addressing import region
from voxspark.model import ABSENT, KNOWN_ZERO, PRESENT

ATOM_KEY = ["az", "ay", "ax"]
REGION_KEY = ["rz", "ry", "rx"]


def with_regions(atoms: DataFrame) -> DataFrame:
    return atoms.withColumns({r: region(a) for r, a in zip(REGION_KEY, ATOM_KEY, strict=True)})


def merge(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, zero regions) of a log (ingest_id, az, ay, ax, kind).

    An atom's cover is the most that any row says, its payload that of the first row that has one. So the result
    doesn't depend on the order, and writing a row again changes nothing.
    """
    marks = log.filter(F.col("kind").isin("atom", "zero_atom"))
    present = F.col("kind") == "atom"
    atoms = marks.groupBy(*ATOM_KEY).agg(
        F.max(F.when(present, PRESENT).otherwise(KNOWN_ZERO)).alias("cover"),
        F.min(F.when(present, F.col("ingest_id"))).alias("payload_id"),
    )
    zero = with_regions(log.filter("kind = 'zero_region'")).select(*REGION_KEY).distinct()
    return atoms, zero


def mark_zero_regions(zero: DataFrame, atoms: DataFrame) -> DataFrame:
    """Of regions to be marked zero, those that hold no present atom: a populated region stays as it is."""
    full = with_regions(atoms.filter(F.col("cover") == PRESENT)).select(*REGION_KEY).distinct()
    return zero.join(full, REGION_KEY, "left_anti")


def resolve(grid: DataFrame, atoms: DataFrame, zero: DataFrame) -> DataFrame:
    """``grid`` with ``cover``: the atom's, else KNOWN_ZERO in a zero region, else ABSENT. Nothing is decoded."""
    own = atoms.select(*ATOM_KEY, F.col("cover").alias("own"))
    return (
        with_regions(grid)
        .join(own, ATOM_KEY, "left")
        .join(zero.select(*REGION_KEY, F.lit(True).alias("zero")), REGION_KEY, "left")
        .withColumn("cover", F.coalesce("own", F.when(F.col("zero"), KNOWN_ZERO), F.lit(ABSENT)))
        .drop("own", "zero", *REGION_KEY)
    )


def absent(grid: DataFrame, atoms: DataFrame, zero: DataFrame) -> DataFrame:
    """Atoms of the grid that nothing is known of: these are to be fetched."""
    return with_regions(grid).join(atoms, ATOM_KEY, "left_anti").join(zero, REGION_KEY, "left_anti").select(*ATOM_KEY)


def read_box(grid: DataFrame, voxels: DataFrame) -> DataFrame:
    """Voxels of a grid (z, y, x), 0 where none is stored."""
    return grid.join(voxels, ["z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def crop(voxels: DataFrame, box) -> DataFrame:
    """Voxels of a box: plain range filters, which Parquet statistics prune by."""
    c = F.col
    return voxels.filter((c("z") >= box.z0) & (c("z") < box.z1) & (c("y") >= box.y0) & (c("y") < box.y1) & (c("x") >= box.x0) & (c("x") < box.x1))
