"""Levels of a volume made while its slabs arrive: each level takes a slab as soon as two of the finer one are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.model import Dims
from voxspark.operators import pyramid

VOXELS = "z int, y int, x int, v int"


def _level(spark: SparkSession, path: str, lod: int) -> DataFrame:
    return spark.read.schema(f"{VOXELS}, batch long").parquet(f"{path}/lod={lod}")


def _raise(spark: SparkSession, path: str, number: int, spans: list[tuple[int, int]]) -> None:
    """Slabs from, up to of each level from 1 on, made of those of the level below and added as one batch's."""
    for lod, (low, high) in enumerate(spans, 1):
        if low < high:
            below = _level(spark, path, lod - 1).filter((F.col("z") >= 2 * low) & (F.col("z") < 2 * high)).drop("batch")
            pyramid.nonzero_mean(below).write.mode("overwrite").parquet(f"{path}/lod={lod}/batch={number}")


def cascade_stream(slabs: DataFrame, path: str, checkpoint: str, dims: Dims) -> None:
    """A stream of voxels (z, y, x, v) to all levels under ``path``, in one folder for each level and batch.

    Slabs come in the order of z and whole. What a batch adds to a level is told by arithmetic on the slabs before and
    after it, so a batch that runs again writes the same folders again; only slabs that are due are read back. At the
    end of the input the last slab of an odd axis is paired with nothing, which counts as 0s.
    """
    spark = slabs.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.select("z", "y", "x", "v").write.mode("overwrite").parquet(f"{path}/lod=0/batch={number}")
        row = _level(spark, path, 0).filter(F.col("batch") <= number).agg(F.max(F.when(F.col("batch") < number, F.col("z"))).alias("before"), F.max("z").alias("after")).first()
        before, after = (-1 if row[k] is None else row[k] for k in ("before", "after"))
        _raise(spark, path, number, [((before + 1) >> lod, (after + 1) >> lod) for lod in range(1, dims.n_lods)])

    query = slabs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = _level(spark, path, 0).agg(F.max("z").alias("z")).first()["z"]
    done = 0 if last is None else last + 1
    _raise(spark, path, 1 << 40, [(done >> lod, dims.lod(lod).nz) for lod in range(1, dims.n_lods)])


def levels(spark: SparkSession, path: str, dims: Dims) -> DataFrame:
    """(z, y, x, v, lod) of all levels that ``cascade_stream`` has made."""
    parts = [_level(spark, path, lod).drop("batch").withColumn("lod", F.lit(lod)) for lod in range(dims.n_lods)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
