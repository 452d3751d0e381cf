"""An append log as a stream: its state converges to what a batch over the whole log gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.operators import coverage
from voxspark.storage import fresh


def merged(partials: DataFrame) -> DataFrame:
    """Partial states of atoms to one: the merge is commutative, associative and idempotent."""
    return partials.groupBy(*coverage.ATOM_KEY).agg(F.max("cover").alias("cover"), F.min("payload_id").alias("payload_id"))


def append_stream(log: DataFrame, path: str, checkpoint: str) -> None:
    """Each micro-batch of a streaming log adds its partial state to ``path``, in a folder of the batch's own.

    A batch that is run again overwrites its folder, so nothing counts twice; an atom may come as late as it likes.
    """

    def put(batch: DataFrame, number: int) -> None:
        atoms, _ = coverage.merge(batch)
        atoms.write.mode("overwrite").parquet(f"{path}/batch={number}")

    log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_stream(spark: SparkSession, sf_dir: str, prepare) -> DataFrame:
    """The final atoms of the events, read as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    path = fresh(spark, "appends")
    append_stream(prepare(events), path, fresh(spark, "appends-checkpoint"))
    return merged(spark.read.parquet(path).select(*coverage.ATOM_KEY, "cover", "payload_id"))


def error_counts(errors: DataFrame, path: str, checkpoint: str) -> None:
    """A stream of (err) to counts of each error: state of 256 rows at most."""

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("err").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    errors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


