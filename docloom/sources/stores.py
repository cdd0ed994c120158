"""Files the engine writes and reads: profiles, discovery records, exports, usage.

Jobs are many, so folders are per hash bucket, never per value. Rows of a bucket are sorted by
value inside their files. The rebalance before a write splits large buckets and joins small
ones by measured size, so that a large job becomes many tasks and files. The index has
stores of its own (`index_store`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators.profiles import export_json
from docloom.session import with_checkpoints

BUCKETS = 64


def bucket(value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _write(df: DataFrame, folder: str, folders: list[str], sort_by: str, mode: str) -> None:
    (
        df.hint("rebalance", *folders)
        .sortWithinPartitions(*folders, sort_by)
        .write.mode(mode)
        .partitionBy(*folders)
        .parquet(folder)
    )


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _replace_jobs(files: DataFrame, folder: str, folders: list[str], buckets: int) -> None:
    """Write the records of the jobs in files in place of their earlier ones.

    Only the job buckets that these jobs fall into are read and written again; the other jobs of
    such a bucket come through. The new rows are cut off from the folder by a checkpoint before
    they replace it, and a folder that loses its last row is removed.
    """
    spark = files.sparkSession
    keyed = files.withColumn("job_bucket", bucket(F.col("job_id"), buckets))
    store, path = _path(spark, folder)
    if not store.exists(path):
        _write(keyed, folder, folders, "job_id", "overwrite")
        return
    with_checkpoints(spark)
    written = keyed.checkpoint()
    touched = written.select("job_bucket").distinct()  # at most `buckets` rows
    stored = read_records(spark, folder, keyed.schema).select(keyed.columns)
    before = stored.join(F.broadcast(touched), "job_bucket", "left_semi").checkpoint()
    after = before.join(written.select("job_id").distinct(), "job_id", "left_anti").select(keyed.columns)
    after = after.unionByName(written).checkpoint()
    emptied = before.select(*folders).distinct().exceptAll(after.select(*folders).distinct()).collect()
    (
        after.hint("rebalance", *folders)
        .sortWithinPartitions(*folders, "job_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(folder)
    )
    for row in emptied:
        gone = "/".join(f"{name}={row[name]}" for name in folders)
        store.delete(_path(spark, f"{folder}/{gone}")[1], True)


def write_discovery(files: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Discovery records by job bucket; a job written again replaces its records."""
    _replace_jobs(files, folder, ["job_bucket"], buckets)


def write_by_category(files: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Files placed in a folder per category; a job written again replaces its files."""
    _replace_jobs(files, folder, ["category", "job_bucket"], buckets)


def read_records(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All records of a store whose columns are known: a store of no record has no file to take them from."""
    return spark.read.schema(schema).parquet(folder)


def read_job(spark: SparkSession, folder: str, job_id: str, buckets: int = BUCKETS, schema: StructType | str | None = None) -> DataFrame:
    """One job's rows: the bucket folder prunes files, the sort order prunes row groups.

    schema: columns of the records and job_bucket, for a store that may hold none.
    """
    records = read_records(spark, folder, schema) if schema else spark.read.parquet(folder)
    return records.filter(
        (F.col("job_bucket") == bucket(F.lit(job_id), buckets)) & (F.col("job_id") == job_id)
    )


def save_profiles(profiles: DataFrame, folder: str, mode: str = "overwrite") -> None:
    profiles.write.mode(mode).json(folder)


def load_profiles(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def export_profiles(items: DataFrame) -> DataFrame:
    """job_id and its JSON without internal keys. Input: job_id, item (map)."""
    return items.select("job_id", export_json(F.col("item")).alias("json"))


def storage_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes per area, the first folder or file name below the root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.element_at(F.split(F.col("path"), F.lit("/" + _quoted(root) + "/")), -1)
    return (
        files.select(F.get(F.split(below, "/"), F.lit(0)).alias("area"), "length")
        .groupBy("area")
        .agg(F.count("*").alias("files"), F.sum("length").alias("total_bytes"))
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"

