"""What is there: atoms, chunks, regions, and what needn't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.functions.addressing import div


def keys(size: int, names: tuple[str, str, str]) -> list:
    return [div(c, size).alias(n) for c, n in zip(("z", "y", "x"), names, strict=True)]


def occupied(voxels: DataFrame, size: int, names: tuple[str, str, str] = ("cz", "cy", "cx")) -> DataFrame:
    """Cubes of ``size`` with a voxel that isn't 0, and how many."""
    return voxels.filter("v <> 0").groupBy(*keys(size, names)).agg(F.count("*").alias("n"))


def atom_stats(voxels: DataFrame, size: int = 32, names: tuple[str, str, str] = ("az", "ay", "ax")) -> DataFrame:
    """Voxels, sum, count of those that aren't 0, and whether all are 0, by cube."""
    return voxels.groupBy(*keys(size, names)).agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.count_if(F.col("v") != 0).alias("nonzero"), (F.max("v") == 0).alias("all_zero"))


def from_coarse(coarse: DataFrame, per_chunk: int) -> DataFrame:
    """Chunks under a coarse voxel that isn't 0. Only kernels that never round to 0 make this exact."""
    return coarse.filter("v <> 0").select(*keys(per_chunk, ("cz", "cy", "cx"))).distinct()


#: Regions of a row that are listed at once, and rows whose lists make a task: four million regions, whatever the grid's size.
TILE, BAND = 512, 8192
#: Tasks at most; beyond it a task has more bands, and no more memory.
MOST_TASKS = 16384


def definite_zero_regions(counts: tuple[int, int, int], chunks: DataFrame, chunk: int, region: int) -> DataFrame:
    """Regions (rz, ry, rx) of a grid of ``counts`` that no occupied chunk touches.

    An overlap of intervals is made an equality: each chunk names the regions that it touches. Regions grow with the
    square of the input, so none is shuffled: the touched ones meet a row for each ``TILE`` regions, which are listed in
    the last step. A tile's rows follow one another, as equal lists take little room in a file.
    """
    touched = chunks
    for r, c, n in zip(("rz", "ry", "rx"), ("cz", "cy", "cx"), counts, strict=True):
        low, high = div(F.col(c) * chunk, region), div(F.col(c) * chunk + chunk - 1, region)
        touched = touched.withColumn(r, F.explode(F.sequence(low, high))).filter(F.col(r).between(0, n - 1))
    nz, ny, nx = counts
    tiles = -(-nx // TILE)
    at = {"rz": f"id div {ny * tiles}", "ry": f"id div {tiles} % {ny}", "tile": f"id % {tiles}"}
    grid = chunks.sparkSession.range(nz * ny * tiles).select(*[F.expr(f"cast({e} AS int)").alias(c) for c, e in at.items()], F.lit(None).cast("int").alias("rx"))
    rows = grid.unionByName(touched.select("rz", "ry", div("rx", TILE).alias("tile"), "rx")).withColumn("band", div("ry", BAND))
    dealt = rows.repartition(max(1, min(MOST_TASKS, nz * -(-ny // BAND) * tiles)), "rz", "band", "tile")
    tile = dealt.groupBy("rz", "band", "tile", "ry").agg(F.collect_set("rx").alias("hit")).sortWithinPartitions("rz", "band", "tile", "ry")
    every = F.sequence(F.col("tile") * TILE, F.least(F.col("tile") * TILE + TILE, F.lit(nx)) - 1)
    return tile.select("rz", "ry", F.explode(F.when(F.size("hit") == 0, every).otherwise(F.array_except(every, "hit"))).alias("rx"))


def only_occupied(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of occupied chunks; nothing of the others is read."""
    return rows.join(chunks, ["cz", "cy", "cx"], "left_semi")
