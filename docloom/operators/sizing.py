"""Size checks that decide how a plan is laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
_FIXED_WIDTH = 16


def _row_bytes(df: DataFrame):
    size = F.lit(_FIXED_WIDTH * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
    return size


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a side is small enough to broadcast, by measure. Only for flat rows; reads at most BROADCAST_ROWS + 1 of them."""
    rows, size = (
        df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    )
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a side of measured size; leave it to a shuffle join when it is larger."""
    return F.broadcast(df) if fits_broadcast(df) else df


def broadcast_if_bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction, e.g. k rows for each of n queries."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a scan has fewer splits than the session has cores.

    Large inputs already have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
