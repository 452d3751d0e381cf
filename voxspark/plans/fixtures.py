"""Volumes made of the driver's tables, in Spark and as DuckDB text with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_V = "cast(CASE WHEN abs(e) < cast(0.05 AS double) THEN 0 ELSE least(255, greatest(1, floor(128 + cast(e AS double) * 240))) END AS int)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v): one voxel for each component of each vector."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return e.select(F.expr("cast(vec_id div 64 AS int)").alias("z"), F.expr("cast(vec_id % 64 AS int)").alias("y"), F.col("i").alias("x"), F.expr(_V).alias("v"))


#: Quads of blocks in a task: 131,072 voxels, whatever the table's size.
QUADS = 8


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quad, block, z, y, x, v): blocks of 16^3, four for each 256 vectors; what the last vectors leave open is 0.

    Vectors are shuffled once, by ``quad``, the 256 of which a block is made, to partitions of a bounded size: grouping
    by ``quad`` and more shuffles no voxels.
    """
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter("vec_id >= 0")
    last = table.agg(F.max("vec_id")).first()[0]
    quads = 0 if last is None else last // 256 + 1
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 64)
    open_ = spark.range(quads * 256).withColumnRenamed("id", "vec_id").join(table.select("vec_id"), "vec_id", "left_anti")
    whole = table.unionByName(open_.withColumn("embedding", zeros)).withColumn("quad", F.expr("vec_id div 256"))
    dealt = whole.repartition(max(1, -(-quads // QUADS)), "quad")
    e = dealt.select("quad", "vec_id", F.posexplode(F.coalesce("embedding", zeros)).alias("i", "e"))
    return e.select("quad", F.expr("cast(vec_id div 256 * 4 + i div 16 AS int)").alias("block"), F.expr("cast(vec_id % 256 div 16 AS int)").alias("z"), F.expr("cast(vec_id % 16 AS int)").alias("y"), F.expr("cast(i % 16 AS int)").alias("x"), F.expr(_V).alias("v"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v): what is written to the voxels of ``sparse``, some of them more than once."""
    li = _table(spark, sf_dir, "lineitem").filter("((l_partkey div 256) + (l_suppkey div 16)) % 3 = 0")
    return li.select(F.expr("cast(l_orderkey % 64 AS int)").alias("z"), F.expr("cast(l_suppkey * 16 AS int)").alias("y"), F.expr("cast(l_partkey AS int)").alias("x"), F.expr("cast(l_quantity AS int) * 5").alias("v"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v): a large sparse volume with absent atoms."""
    return entries(spark, sf_dir).groupBy("z", "y", "x").agg(F.max("v").alias("v"))


def reconstruction(voxels: DataFrame) -> DataFrame:
    """``voxels`` with a deterministic error on those that aren't 0."""
    return voxels.withColumn("v", F.expr("CASE WHEN v > 0 THEN greatest(0, least(255, v + ((z * 7 + y * 13 + x * 17) % 9) - 4)) ELSE 0 END"))


def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(_table(spark, sf_dir, "events"))


def log_of(e: DataFrame) -> DataFrame:
    """(ingest_id, ts, az, ay, ax, kind) of events, a stream or not: atoms and marks in the order they were written."""
    kind = F.expr("CASE WHEN event_type = 'error' THEN 'zero_atom' WHEN event_type = 'signup' THEN CASE WHEN event_id % 500 = 0 THEN 'zero_region' ELSE 'none' END ELSE 'atom' END")
    return e.select(F.col("event_id").alias("ingest_id"), "ts", F.expr("cast(((event_id * 7) % 16) * 4 AS int)").alias("az"), F.expr("cast(user_id % 32 AS int)").alias("ay"), F.expr("cast((cast(floor(value) AS bigint) % 16) * 8 AS int)").alias("ax"), kind.alias("kind"))


#: Named subqueries of the SQL that checks the queries.
SQL = {
    "vd": f"SELECT cast(vec_id // 64 AS int) z, cast(vec_id % 64 AS int) y, cast(i - 1 AS int) x, {_V.replace('(e', '(embedding[i]').replace('cast(e ', 'cast(embedding[i] ')} v FROM embeddings, unnest(generate_series(1, 64)) g(i)",
    "vb": f"SELECT cast(vec_id // 256 * 4 + (i - 1) // 16 AS int) block, cast(vec_id % 256 // 16 AS int) z, cast(vec_id % 16 AS int) y, cast((i - 1) % 16 AS int) x, {_V} v FROM (SELECT vec_id, i, coalesce(embedding[i], 0) e FROM range(0, (SELECT (max(vec_id) // 256 + 1) * 256 FROM embeddings)) r(vec_id) LEFT JOIN embeddings USING (vec_id), unnest(generate_series(1, 64)) g(i))",
    "vs": "SELECT cast(l_orderkey % 64 AS int) z, cast(l_suppkey * 16 AS int) y, cast(l_partkey AS int) x, max(cast(floor(l_quantity) AS int) * 5) v FROM lineitem WHERE ((l_partkey // 256) + (l_suppkey // 16)) % 3 = 0 GROUP BY ALL",
    "vr": "SELECT z, y, x, CASE WHEN v > 0 THEN greatest(0, least(255, v + ((z * 7 + y * 13 + x * 17) % 9) - 4)) ELSE 0 END v FROM vd",
    "ev": "SELECT event_id ingest_id, cast(((event_id * 7) % 16) * 4 AS int) az, cast(user_id % 32 AS int) ay, cast((cast(floor(value) AS bigint) % 16) * 8 AS int) ax, CASE WHEN event_type = 'error' THEN 'zero_atom' WHEN event_type = 'signup' THEN CASE WHEN event_id % 500 = 0 THEN 'zero_region' ELSE 'none' END ELSE 'atom' END kind FROM events",
}
_NEEDS = {"vr": ["vd"]}


def sql(query: str, *names: str) -> str:
    """``query`` with the fixtures it names."""
    all_names = list(dict.fromkeys([*(n for name in names for n in _NEEDS.get(name, [])), *names]))
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in all_names) + ("," if query.lstrip().startswith("+") else "") + " " + query.lstrip().removeprefix("+")
