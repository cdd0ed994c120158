"""Job status as a stream over the event log.

The stream holds no state: each batch is reduced to one row a job, and rows of several batches are
merged by the times of their events. Events may arrive in any order and more than once. The
batches are kept as a base and the batches since (`batches`), so a reader opens a bounded number of folders
however long the stream has run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.jobs import status_columns
from docloom.streaming import batches


def batch_status(events: DataFrame) -> DataFrame:
    """One row a job: its last event with status and error, and its last event that names a phase."""
    at = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"))
    named = F.when(F.col("phase").isNotNull(), at)
    return events.groupBy("job_id").agg(
        F.max(at).alias("last_event"), F.max_by(F.struct("status", "error"), at).alias("last"),
        F.max(named).alias("phase_event"), F.max_by("phase", named).alias("phase"),
    )


def merged_status(rows: DataFrame) -> DataFrame:
    """Rows of several batches as one row a job."""
    return rows.groupBy("job_id").agg(
        F.max("last_event").alias("last_event"), F.max_by("last", "last_event").alias("last"),
        F.max("phase_event").alias("phase_event"), F.max_by("phase", "phase_event").alias("phase"),
    )


def start_status_stream(events: DataFrame, folder: str, checkpoint: str, merge_every: int = batches.MERGE_EVERY) -> StreamingQuery:
    """Keep the status of all jobs in a folder; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batches.write_rows(batch_status(batch), f"{folder}/batch={batch_id}")
        whole = lambda: merged_status(batches.read(spark, folder, before=batch_id + 1))
        batches.merge(spark, folder, batch_id, merge_every, whole, batches.write_rows)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_status(spark: SparkSession, folder: str) -> DataFrame:
    """job_id, status, phase, progress, error: the newest of each job over the base and the batches since."""
    return merged_status(batches.read(spark, folder)).select(*status_columns())
