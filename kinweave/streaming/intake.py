"""Edge submissions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.review import intake

SUBMISSION = "source_id string, target_id string, type string, evidence string, contributor string, submitted_at timestamp"
EDGE = ("source_id string, target_id string, type string, directed boolean, confidence string, evidence string, "
        "origin string, status string, submitted_at timestamp, batch long")


def read_submissions(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """Submission files as they arrive, at most ``max_files`` per micro-batch."""
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def start_intake(submissions: DataFrame, existing: DataFrame, out: str, checkpoint: str,
                 once: bool = False) -> StreamingQuery:
    """Append new edges of each micro-batch to ``out``, as the batch form ``intake`` would.

    A batch is compared with the known edges and with all edges taken in before, so a repeat is found
    however late it comes and no watermark can let it through. Each batch owns one folder and
    overwrites it, so a batch that is run again after a failure leaves no doubles.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        earlier = batch.sparkSession.read.schema(EDGE).parquet(out).filter(f"batch < {batch_id}")
        columns = ["source_id", "target_id", "type"]
        known = existing.select(*columns).unionByName(earlier.select(*columns))
        intake(batch, known).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # An empty first folder, so the first batch finds a table to read.
    empty = submissions.sparkSession.createDataFrame([], EDGE).drop("batch")
    empty.write.mode("ignore").parquet(f"{out}/batch=-1")
    writer = submissions.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
