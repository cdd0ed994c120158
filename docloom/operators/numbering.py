"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def number_rows(df: DataFrame, group: list[str], order: str, into: str, block_width: int = BLOCK_ROWS) -> DataFrame:
    """Adds `into`: 0, 1, 2, ... by the whole-number column `order` within each group.

    Rows are numbered inside blocks of block_width order values, and each block starts at
    the count of the blocks before it. A group of any size is spread over its blocks;
    only their counts come together.
    """
    keys = [*group, "block"]
    blocked = df.withColumn("block", F.floor(F.col(order) / block_width))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = blocked.withColumn("inside", inside).join(starts, keys)
    return numbered.withColumn(into, F.col("start") + F.col("inside") - 1).drop("block", "inside", "start")
