"""Tables that a job cuts its lineage with, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(8)
def _own_dir(application: str) -> str:
    path = tempfile.mkdtemp(prefix="voxspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this driver's where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own_dir(spark.sparkContext.applicationId)


def fresh(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lost executors cost no more than a read.

    A ``narrow`` table (ids, counts) is written by four tasks a core at most, not a file for each shuffle partition.
    """
    path = fresh(df.sparkSession, name)
    out = df.coalesce(max(16, 4 * df.sparkSession.sparkContext.defaultParallelism)) if narrow else df
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
