from pyspark.sql import functions as F

from voxspark.operators import coverage
from voxspark.streaming import appends

KINDS = ["atom", "zero_atom", "atom", "none", "zero_region"]


def log(spark, n):
    return spark.range(n).select(
        F.col("id").alias("ingest_id"), F.expr("cast(id * 7 % 5 AS int)").alias("az"), F.expr("cast(id * 3 % 4 AS int)").alias("ay"), F.expr("cast(id % 3 AS int)").alias("ax"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 5 + 1).cast("int")).alias("kind"),
    )


def test_stream_converges_to_the_batch(spark, tmp_path):
    rows = log(spark, 400)
    rows.repartition(6).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    for _ in range(2):  # a second start finds nothing new and changes nothing
        appends.append_stream(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
    got = appends.merged(spark.read.parquet(str(tmp_path / "state")).select("az", "ay", "ax", "cover", "payload_id"))
    assert sorted(got.collect()) == sorted(coverage.merge(rows)[0].select(*got.columns).collect())
    assert spark.read.parquet(str(tmp_path / "state")).select("batch").distinct().count() > 3


def test_merge_is_idempotent_and_orderless(spark):
    rows = log(spark, 200)
    twice = rows.unionByName(rows.orderBy(F.desc("ingest_id")))
    assert sorted(coverage.merge(twice)[0].collect()) == sorted(coverage.merge(rows)[0].collect())


def test_error_counts(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).cast("int").alias("err")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("err int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    appends.error_counts(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r.err: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("err").agg(F.sum("n").alias("n")).collect()}
    assert got == {e: len(range(e, 1000, 7)) for e in range(7)}


def test_levels_of_a_stream_of_slabs(spark, tmp_path):
    import os

    import numpy as np

    from tests.test_codec import frame
    from voxspark.model import Dims
    from voxspark.operators import metrics, pyramid
    from voxspark.streaming import cascade

    rng = np.random.default_rng(8)
    v = rng.integers(0, 256, (11, 6, 5)) * (rng.random((11, 6, 5)) < 0.7)
    v[4], v[10] = 0, 0
    dims, whole = Dims(5, 6, 11), frame(spark, v).filter("v <> 0").selectExpr(*[f"cast({c} AS int) {c}" for c in "zyxv"])
    for k, (low, high) in enumerate([(0, 3), (3, 4), (4, 5), (5, 9), (9, 11)]):
        part = whole.filter((F.col("z") >= low) & (F.col("z") < high)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            if name.startswith("part-") and os.stat(tmp_path / "in" / name).st_mtime > 2_000:
                os.utime(tmp_path / "in" / name, (1000 + k, 1000 + k))
    stream = spark.readStream.schema("z int, y int, x int, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cascade.cascade_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), dims)
    got = cascade.levels(spark, str(tmp_path / "out"), dims)
    want = pyramid.levels(whole, lambda x, _: pyramid.nonzero_mean(x), dims.n_lods)
    for lod in range(dims.n_lods):
        assert metrics.differing(got.filter(F.col("lod") == lod).drop("lod"), want.filter(F.col("lod") == lod).drop("lod")).count() == 0, lod
    assert got.filter("lod > 0").count() > 40
