"""Job status and timing from an event log.

Input events: job_id, event_id, ts, phase, status, error. A hot job may own any share of
the log: latest values and rates use partial aggregation, durations use ranges of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.lookup import lookup
from docloom.session import with_checkpoints


def phase_progress(phase: Column) -> Column:
    return lookup(fv.PHASE_PROGRESS, phase)


def latest_columns() -> list[Column]:
    """Aggregates for the last status and the last known phase; ties in time go to the larger event id."""
    at = F.struct("ts", "event_id")
    last = F.max_by(F.struct("status", "error"), at)
    return [
        F.max(at).alias("last_event"),
        last.alias("last"),
        F.max_by("phase", F.when(F.col("phase").isNotNull(), at)).alias("phase"),
    ]


def status_columns() -> list[Column]:
    status = F.col("last.status")
    progress = F.when(status == "completed", F.lit(100.0)).otherwise(F.coalesce(phase_progress(F.col("phase")), F.lit(0.0)))
    return [F.col("job_id"), status.alias("status"), F.col("phase"), progress.alias("progress"),
            F.col("last.error").alias("error")]


def latest_status(events: DataFrame) -> DataFrame:
    """job_id, status, phase, progress, error. A failed job keeps the phase it failed in."""
    return events.groupBy("job_id").agg(*latest_columns()).select(*status_columns())


def count_by_status(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("jobs"))


def phase_durations(events: DataFrame) -> DataFrame:
    """job_id, event_id, phase, seconds until the job's next event (null for its last).

    Events are dealt to ranges of (job, time, event), so that a job of any length is spread over all
    tasks. The next event is looked up inside a range of the job; the last event of a range takes
    the first event of the job's next range: one row a job and range. Dealt events are written
    once, because both sides must come from the same ranges.
    """
    with_checkpoints(events.sparkSession)
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    order = ["job_id", "at", "event_id"]
    dealt = events.select("job_id", "event_id", "phase", at).repartitionByRange(*order)
    dealt = dealt.withColumn("range", F.spark_partition_id()).checkpoint()
    starts = dealt.groupBy("job_id", "range").agg(F.min("at").alias("first_at"))
    following = F.lead("first_at").over(Window.partitionBy("job_id").orderBy("range"))
    starts = starts.select("job_id", "range", following.alias("next_range_at"))
    inside = Window.partitionBy("job_id", "range").orderBy("at", "event_id")
    next_at = F.coalesce(F.lead("at").over(inside), F.col("next_range_at"))
    return dealt.join(starts, ["job_id", "range"]).select(
        "job_id", "event_id", "phase", ((next_at - F.col("at")) / F.lit(1e6)).alias("seconds")
    )


def phase_totals(durations: DataFrame) -> DataFrame:
    """Events and total seconds per phase."""
    return durations.groupBy("phase").agg(
        F.count("*").alias("events"), F.round(F.sum("seconds"), 3).alias("total_seconds")
    )


def outcome_rates(statuses: DataFrame) -> DataFrame:
    """Shares of completed and failed jobs."""
    share = lambda status: F.round(F.avg((F.col("status") == status).cast("double")), 6)
    return statuses.agg(
        F.count("*").alias("jobs"),
        share("completed").alias("success_rate"),
        share("failed").alias("failure_rate"),
    )
