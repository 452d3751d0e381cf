"""Blocks of documents, and the tables that the queries read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.storage import shared_dir, written

#: Spark refuses tables of more than 100,000 buckets.
MOST_BUCKETS = 50_000


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, with 64 for each row."""
    row = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64)).alias("b")).first()
    return int(row["b"] or 0)


def blocks_for(docs: DataFrame, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the table makes: it grows with the input, a block doesn't."""
    return max(1, -(-text_bytes(docs) // block_bytes))


def sized(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A written table of one long column: sent to all tasks if it has at most ``most`` rows, 16 MB; else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def in_blocks(docs: DataFrame, block_bytes: int, name: str) -> DataFrame:
    """``docs`` (with a column ``text``) and a long column ``block``, written bucketed by it.

    A block is a run of rows of one scan partition with about ``block_bytes`` of text, so rows of one id, copies and
    rows without an id are spread as the table spreads them, and no text is shuffled, neither here nor by grouping by
    block later. Buckets hold several blocks where there are more blocks than ``MOST_BUCKETS``. A text longer than a
    block is one by itself.
    """
    spark = docs.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    at = docs.columns.index("text")
    names = [*docs.columns, "block"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, base = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            own = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            upto = size + np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + (upto - own) // block_bytes)], names)
            size = int(upto[-1]) if len(upto) else size

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    buckets = min(blocks_for(docs, block_bytes), MOST_BUCKETS)
    dealt = docs.mapInArrow(cut, f"{fields}, block long")
    dealt.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{table}").option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Hash bucket 0 to n - 1 of 64-bit keys; ordered keys have ordered buckets."""
    with np.errstate(over="ignore"):
        return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of an ordered array."""
    if not len(bucket):
        return []
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[edge].tolist(), edge.tolist(), np.append(edge[1:], len(bucket)).tolist(), strict=True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


__all__ = ["benchmark", "blocks_for", "bucket_of", "documents", "in_blocks", "runs", "sized", "text_bytes", "written"]
