"""Integer DCT and quantisation in long form: joins with small tables and grouped sums, checked by SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
SHIFT = 14


def dct_matrix(n: int) -> list[tuple[int, int, int]]:
    """(k, i, c): orthonormal DCT-II coefficients scaled by 2^14, rounded half away from 0."""
    out = []
    for k in range(n):
        scale = math.sqrt((1 if k == 0 else 2) / n)
        for i in range(n):
            c = scale * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) * (1 << SHIFT)
            out.append((k, i, int(math.copysign(math.floor(abs(c) + 0.5), c))))
    return out


def step_table(n: int, q: float) -> list[tuple[int, int]]:
    """(f, sq): the quantiser step of each L1 frequency, (1 + f)^0.65 * q, scaled by 2^20."""
    return [(f, round((1 + f) ** 0.65 * q * (1 << 20))) for f in range(3 * n - 2)]


def scan_order(n: int) -> list[tuple[int, int]]:
    """(place, raster index) of an n^3 block by L1 frequency, then raster."""
    by = sorted(range(n**3), key=lambda i: (i // (n * n) + i // n % n + i % n, i))
    return list(enumerate(by))


def small_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of fixed size, n^2 rows of a matrix or 3n - 2 steps: small enough to be sent to all tasks."""
    return F.broadcast(spark.createDataFrame(rows, columns))


def lines(values: DataFrame, matrix: DataFrame, keys: list[str], axis: str, inverse: bool = False) -> DataFrame:
    """One pass along an axis: every line of n values to n sums, shifted down with rounding."""
    by, to = ("k", "i") if inverse else ("i", "k")
    other = [c for c in keys if c != axis]
    joined = values.join(matrix.select(F.col(by).alias(axis), F.col(to).alias("__to"), "c"), axis)
    total = F.sum(F.col("c").cast("long") * F.col("v")) + (1 << (SHIFT - 1))
    return joined.groupBy(*other, F.col("__to").alias(axis)).agg(F.shiftright(total, SHIFT).alias("v"))


def forward(spark: SparkSession, values: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """3-D DCT of (keys.., v): x, y, then z; the rounding of each pass makes the order matter."""
    matrix = small_table(spark, dct_matrix(n), "k int, i int, c int")
    for axis in AXES:
        values = lines(values, matrix, keys, axis)
    return values


def inverse(spark: SparkSession, values: DataFrame, n: int, keys: list[str]) -> DataFrame:
    matrix = small_table(spark, dct_matrix(n), "k int, i int, c int")
    for axis in AXES:
        values = lines(values, matrix, keys, axis, inverse=True)
    return values


def with_frequency(values: DataFrame) -> DataFrame:
    return values.withColumn("f", F.col("z") + F.col("y") + F.col("x"))


def level_of(value: str, sq: str):
    """The dead-zone level of a coefficient at a step scaled by 2^20, in integers."""
    return F.expr(f"cast(CASE WHEN 10 * abs({value}) * 1048576 >= 8 * {sq} THEN least(32767, (abs({value}) * 10485760 - 8 * {sq}) div (10 * {sq}) + 1) * sign({value}) ELSE 0 END AS int)")


def quantize(spark: SparkSession, values: DataFrame, n: int, q: float) -> DataFrame:
    """Dead-zone levels: 0 below 0.8 steps, else one more for each step from there on; integers throughout."""
    steps = small_table(spark, step_table(n, q), "f int, sq long")
    return with_frequency(values).join(steps, "f").withColumn("level", level_of("v", "sq"))


def dequantize(levels: DataFrame) -> DataFrame:
    """(.., level, sq) to the middle of their bins, rounded half up."""
    size = F.floor((F.abs("level") + F.lit(0.2)) * F.col("sq") / F.lit(1048576.0) + F.lit(0.5)).cast("long")
    return levels.withColumn("v", F.when(F.col("level") == 0, F.lit(0).cast("long")).when(F.col("level") > 0, size).otherwise(-size))


def dequantize_q8(levels: DataFrame) -> DataFrame:
    """The integer form: step and offset in 1/256, rounded half to even when they are made."""
    s = F.col("sq") / F.lit(1048576.0)
    r = F.shiftright(F.abs("level").cast("long") * F.rint(256 * s).cast("long") + F.rint(F.lit(256 * 0.2) * s).cast("long") + 128, 8)
    return levels.withColumn("v", F.when(F.col("level") < 0, -r).otherwise(r))


def end_of_block(spark: SparkSession, levels: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """One more than the last place in scan order that isn't 0, by block."""
    scan = spark.createDataFrame(scan_order(n), "p int, idx int")
    placed = levels.withColumn("idx", (F.col("z") * n + F.col("y")) * n + F.col("x")).join(F.broadcast(scan), "idx")
    return placed.groupBy(*keys).agg(F.max(F.when(F.col("level") != 0, F.col("p") + 1).otherwise(0)).alias("eob"))


def values_sql(rows: list[tuple], columns: str) -> str:
    """A fixed table as SQL text."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)}) t({columns}))"
