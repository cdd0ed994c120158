"""A stored table that edits change in place: only the buckets of the edited keys are written again.

A store is a folder of hash buckets of its key, with the number of buckets chosen from the measured data. A
batch of edits reads the buckets of its keys, applies an edit function to them, and overwrites these folders
alone. Every row names the batch that wrote its bucket last, so a batch that is retried, also one that
failed between two folders, skips the buckets it had written and applies once. Batches come one
after the other, with rising numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import with_checkpoints
from docloom.sources.index_store import bucket, buckets_for

BUCKET, BATCH = "store_bucket", "store_batch"
ROW_BYTES = 200  # of a profile or service row as stored
_LAYOUT = "key string, buckets int, columns string"

Edit = Callable[[DataFrame, DataFrame], DataFrame]


def _place(rows: DataFrame, key: str, buckets: int, batch_id: int) -> DataFrame:
    return rows.withColumns({BUCKET: bucket(F.col(key).cast("string"), buckets), BATCH: F.lit(batch_id).cast("bigint")})


def _write(rows: DataFrame, folder: str, key: str, mode: str) -> None:
    """A bucket above the session's advisory size becomes several files."""
    (
        rows.hint("rebalance", BUCKET)
        .sortWithinPartitions(BUCKET, key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(BUCKET)
        .parquet(f"{folder}/data")
    )


def create(table: DataFrame, folder: str, key: str) -> None:
    """A new store of the rows of a table, counted first to size the buckets. Rows without a key are kept in the bucket of null."""
    spark = table.sparkSession
    buckets = buckets_for(table.count() * ROW_BYTES)
    _write(_place(table, key, buckets, -1), folder, key, "static")
    layout = [(key, buckets, table.schema.json())]
    spark.createDataFrame(layout, _LAYOUT).coalesce(1).write.mode("overwrite").json(f"{folder}/layout")


def _layout(spark: SparkSession, folder: str) -> tuple[str, int, T.StructType]:
    row = spark.read.schema(_LAYOUT).json(f"{folder}/layout").first()
    return row["key"], row["buckets"], T.StructType.fromJson(json.loads(row["columns"]))


def _stored(spark: SparkSession, folder: str, columns: T.StructType) -> DataFrame:
    """All rows with the bucket and the batch that wrote it; also where no row is left."""
    own = T.StructType([*columns.fields, T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(own).parquet(f"{folder}/data")


def read(spark: SparkSession, folder: str, keys: list | None = None) -> DataFrame:
    """The rows of a store; of the named keys only their buckets and row groups are read."""
    key, buckets, columns = _layout(spark, folder)
    rows = _stored(spark, folder, columns)
    if keys is not None:
        kind = columns[key].dataType
        named = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)]))
        folders = [r[0] for r in named.select(bucket(F.col("k").cast("string"), buckets)).distinct().collect()]
        rows = rows.filter(F.col(BUCKET).isin(folders) & F.col(key).isin(keys))
    return rows.select(columns.names)


def apply(spark: SparkSession, folder: str, batch_id: int, changes: DataFrame, edit: Edit) -> int:
    """Apply edit(rows, changes) to the buckets that the keys in changes fall into; how many buckets were written.

    edit sees the rows of these buckets and the changes that belong to them, and returns the rows that replace
    them. At most as many numbers as there are buckets come to the driver. New rows are cut off from the folder by a
    checkpoint before they replace it; a bucket without rows loses its folder.
    """
    with_checkpoints(spark)
    key, buckets, columns = _layout(spark, folder)
    changes = changes.withColumn(BUCKET, bucket(F.col(key).cast("string"), buckets)).checkpoint()
    touched = {r[0] for r in changes.select(BUCKET).distinct().collect()}
    stored = _stored(spark, folder, columns).filter(F.col(BUCKET).isin(sorted(touched)))
    done = stored.groupBy(BUCKET).agg(F.max(BATCH).alias("b")).filter(F.col("b") >= batch_id).collect()
    left = sorted(touched - {r[BUCKET] for r in done})
    if not left:
        return 0
    mine = F.col(BUCKET).isin(left)
    edited = edit(stored.filter(mine).select(columns.names), changes.filter(mine).drop(BUCKET)).select(columns.names)
    after = _place(edited, key, buckets, batch_id).checkpoint()
    _write(after, folder, key, "dynamic")
    kept = {r[0] for r in after.select(BUCKET).distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    for gone in set(left) - kept:
        emptied = path(f"{folder}/data/{BUCKET}={gone}")
        emptied.getFileSystem(spark._jsc.hadoopConfiguration()).delete(emptied, True)
    return len(left)
