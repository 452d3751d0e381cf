"""Sharding: a uniform shuffle with exact shard sizes, drawn as a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxspark.llm.shared import written

#: The matrix is drawn in two steps: on the driver for so many groups of cells at most, then for each group in a task.
MOST_GROUPS = 1024


def communication_matrix(counts: np.ndarray, room: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """Rows of each partition that go to each shard: what a uniform permutation cut into shards of ``room`` would give.

    Row by row, a multivariate hypergeometric draw from the room left in the shards. Columns add up to ``room``,
    rows to ``counts``.
    """
    rng = np.random.default_rng(seed)
    room, out = room.astype(np.int64).copy(), np.zeros((len(counts), len(room)), np.int64)
    for p, n in enumerate(counts):
        out[p] = rng.multivariate_hypergeometric(room, int(n), method="marginals")
        room -= out[p]
    return out


def even(total: int, n_shards: int) -> np.ndarray:
    """Shard sizes at most one apart."""
    return total // n_shards + (np.arange(n_shards) < total % n_shards)


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 11, rows_per_cell: int = 100_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): each row's shard and its place there, gapless from 0.

    Cells are runs of at most ``rows_per_cell`` rows of the table's own partitions. Every row draws two random numbers
    from its partition's generator, whatever it holds, so copies part like any rows; the narrow rows are written
    with them once. The matrix says how many rows each cell sends to each shard: groups of cells are drawn on the
    driver, at most ``MOST_GROUPS`` rows of the matrix; each group's cells are then drawn from the group's row in a
    task, which is the same law. Rows are ranked within their cell by the first number and so take their shard,
    and within parts of the shard by the second, which gives the slots. Texts are never shuffled.

    Null texts count as empty; null ids and repeated rows are rows like others; an empty table gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    uid = F.monotonically_increasing_id()
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        uid.alias("uid"),
        F.rand(seed).alias("a"),
        F.rand(seed + 1_000_003).alias("b"),
    )
    # The upper bits of uid are the partition, the lower 33 count its rows.
    narrow = narrow.withColumn("cell", F.col("uid") - F.pmod(F.col("uid").bitwiseAND((1 << 33) - 1), F.lit(rows_per_cell)))
    narrow = written(narrow, "shard-rows")
    cells = written(narrow.groupBy("cell").agg(F.count("*").alias("n")).withColumn("group", F.pmod(F.xxhash64("cell"), F.lit(MOST_GROUPS)).cast("int")), "shard-cells")
    counts = np.zeros(MOST_GROUPS, np.int64)
    for r in cells.groupBy("group").agg(F.sum("n").alias("n")).collect():
        counts[r["group"]] = r["n"]
    total = int(counts.sum())
    drawn = communication_matrix(counts, even(total, n_shards), seed)

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        group = table.column("group")[0].as_py()
        upto = np.cumsum(communication_matrix(table.column("n").to_numpy(), drawn[group], [seed, group]), axis=1)
        return pa.table({"cell": table.column("cell"), "upto": pa.array(list(upto), pa.list_(pa.int64()))})

    matrix = written(cells.groupBy("group").applyInArrow(draw, "cell long, upto array<long>"), "shard-matrix")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("a", "uid"))
    parts = max(1, -(-total // (n_shards * rows_per_cell)))
    sent = (
        narrow.withColumn("rank", rank)
        .join(matrix, "cell")
        .withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank"))).cast("int"))
        .withColumn("part", F.floor(F.col("b") * parts).cast("long"))
        .select("doc_id", "size", "text_crc32", "shard", "part", "b", "uid")
    )
    sent = written(sent, "shard-sent")
    sizes = sent.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shard-bases")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("b", "uid"))
    return (
        sent.withColumn("place", place)
        .join(base, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"))
    )


def sharding_digest(docs: DataFrame) -> DataFrame:
    """``shard_rows`` with its law, ``rows``; nulls, empty texts, copies and empty tables as there."""
    return shard_rows(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
