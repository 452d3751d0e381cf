"""Downscaling by two, and the levels of a volume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.functions.addressing import div
from voxspark.model import Extent

def halves() -> list[Column]:
    return [div(c, 2).alias(c) for c in ("z", "y", "x")]


def _weight(dims: Extent) -> Column:
    """How often a voxel counts where the last of an odd axis is replicated."""
    out = F.lit(1)
    for c, d in (("z", dims.nz), ("y", dims.ny), ("x", dims.nx)):
        if d % 2:
            out = out * F.when(F.col(c) == d - 1, 2).otherwise(1)
    return out


def box(voxels: DataFrame, dims: Extent) -> DataFrame:
    """Mean of the eight children, half up; the last of an odd axis counts twice."""
    return voxels.groupBy(*halves()).agg(F.floor(F.sum(F.col("v") * _weight(dims)) / 8 + F.lit(0.5)).cast("int").alias("v"))


def cbox(voxels: DataFrame, dims: Extent, alpha: float = 0.5) -> DataFrame:
    """The mean moved by ``alpha`` towards the child that stands out most, the first of equals in z, y, x order."""
    order = (F.col("z") % 2) * 4 + (F.col("y") % 2) * 2 + F.col("x") % 2
    children = voxels.withColumns({"w": _weight(dims), "o": order}).groupBy(*halves()).agg(F.collect_list(F.struct("o", "v", "w")).alias("c"), F.sum(F.col("v") * _weight(dims)).alias("s"))
    mean = F.col("s") / F.lit(8.0)
    far = F.array_max(F.transform("c", lambda c: F.struct(F.abs(c["v"] - mean).alias("d"), (-c["o"]).alias("o"), c["v"].alias("v"))))
    return children.withColumn("v", F.when(F.col("s") == 0, 0).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(mean + F.lit(alpha) * (far["v"] - mean) + 0.5)))).cast("int")).select("z", "y", "x", "v")


def whole_cubes(voxels: DataFrame, dims: Extent) -> DataFrame:
    """``voxels`` with the 0s that their cubes of two lack, as far as these lie in the volume."""
    at = [F.explode(F.sequence(F.col(f"h{c}") * 2, F.least(F.col(f"h{c}") * 2 + 1, F.lit(d - 1)))).alias(c) for c, d in (("z", dims.nz), ("y", dims.ny), ("x", dims.nx))]
    cubes = voxels.select(*[div(c, 2).alias(f"h{c}") for c in ("z", "y", "x")]).distinct()
    for e in at:
        cubes = cubes.select("*", e)
    return cubes.select("z", "y", "x").join(voxels, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def mean_round(voxels: DataFrame) -> DataFrame:
    """Mean of the children there are, half up."""
    return voxels.groupBy(*halves()).agg(F.expr("cast((sum(v) + count(*) div 2) div count(*) AS int)").alias("v"))


def nonzero_mean(voxels: DataFrame) -> DataFrame:
    """Mean of the children that aren't 0, half up; 0 where all are."""
    some = F.expr("CASE WHEN count_if(v <> 0) = 0 THEN 0 ELSE cast((sum(v) + count_if(v <> 0) div 2) div count_if(v <> 0) AS int) END")
    return voxels.groupBy(*halves()).agg(some.alias("v"))


def mask_vote(voxels: DataFrame, votes: int) -> DataFrame:
    """Air (v = 0) of the coarser level: 0 if all children are, 1 if most are, 2 if any is."""
    air, n = F.count_if(F.col("v") == 0), F.count("*")
    test = {0: air == n, 1: air * 2 > n, 2: air > 0}[votes]
    return voxels.groupBy(*halves()).agg(test.alias("air"))


def levels(voxels: DataFrame, step: Callable[[DataFrame, int], DataFrame], n: int) -> DataFrame:
    """All levels with ``lod``: each is made of the one before, as each rounds its own output."""
    out = voxels.withColumn("lod", F.lit(0))
    for k in range(1, n):
        voxels = step(voxels, k)
        out = out.unionByName(voxels.withColumn("lod", F.lit(k)))
    return out


def residual(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Fine voxels less the coarse voxel above them."""
    up = coarse.select(F.col("z").alias("cz"), F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("v").alias("p"))
    on = [div("z", 2) == F.col("cz"), div("y", 2) == F.col("cy"), div("x", 2) == F.col("cx")]
    return fine.join(up, on, "left").select("z", "y", "x", (F.col("v") - F.coalesce("p", F.lit(0))).alias("r"))


def deblock(voxels: DataFrame, step: int, strength: float, limit: int) -> DataFrame:
    """``voxels`` with the two on either side of each seam moved towards each other, along x, then y, then z.

    Seams lie at multiples of ``step``. Pairs with air, or whose difference reaches ``limit``, stay: they are edges.
    A voxel is in one pair at most along an axis, so a pair is a group of two rows.
    """
    if step < 2:
        raise ValueError("a seam needs a voxel of its own on either side")
    for c in ("x", "y", "z"):
        place = F.col(c) % step
        seam = F.when((place == 0) & (F.col(c) > 0), F.col(c)).when(place == step - 1, F.col(c) + 1)
        at = voxels.withColumn("__seam", seam)
        others = [k for k in ("z", "y", "x") if k != c]
        low, high = F.max(F.when(F.col(c) < F.col("__seam"), F.col("v"))), F.max(F.when(F.col(c) == F.col("__seam"), F.col("v")))
        pairs = at.filter("__seam IS NOT NULL").groupBy(*others, "__seam").agg(low.alias("a"), high.alias("b"))
        d = F.col("b") - F.col("a")
        move = F.when((F.col("a") != 0) & (F.col("b") != 0) & (F.abs(d) < limit), (F.lit(strength / 2) * d).cast("int")).otherwise(0)
        clamp = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), e)).cast("int")
        there = lambda side, e: F.when(F.col(side).isNotNull(), clamp(e)).alias("v")
        move = F.coalesce(move, F.lit(0))
        sides = F.array(F.struct((F.col("__seam") - 1).alias(c), there("a", F.col("a") + move)), F.struct(F.col("__seam").alias(c), there("b", F.col("b") - move)))
        moved = pairs.select(*others, F.explode(sides).alias("s")).select(*others, "s.*").filter("v IS NOT NULL")
        voxels = at.filter("__seam IS NULL").select("z", "y", "x", F.col("v").cast("int").alias("v")).unionByName(moved.select("z", "y", "x", "v"))
    return voxels
