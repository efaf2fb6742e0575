"""Cutting lineage in loops with written tables, so a lost executor costs a re-read only.

Tables go to the folder that ``spark.checkpoint.dir`` names. They beat ``checkpoint()`` here: they
are columnar, their size is known to the planner, and no filter constraints pile up round by round.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names; where it names none, one in the warehouse, which is shared too."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_kinweave_steps"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    spark = df.sparkSession
    path = step_path(spark, "kinweave")
    df.write.parquet(path, compression="zstd")  # a table that is read a few times should be small
    return spark.read.schema(df.schema).parquet(path)


def step_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which ``release`` or the end of the process deletes."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_at_exit, spark)
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables this process has cut so far; call it when no frame built on them is needed."""
    context = spark.sparkContext
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    """Delete what is left, if the session still runs."""
    with contextlib.suppress(Exception):
        release(spark)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows read from too few files over all cores before CPU-heavy work.

    For use right after a scan. Where the scan has a task per core anyway, nothing is shuffled.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
