"""Tables kept as a base and the batches since: what foreachBatch sinks write and readers merge.

A table is a folder with `batch=N` folders, one a stream batch, and `base=K` folders that hold all batches
up to K merged. A batch that is repeated after a failure overwrites its own folder. A base counts
once its _SUCCESS file is there; readers take the newest one and the batches after it, so they open a
bounded number of folders and never see a merge half done. Merged folders are deleted one merge
later, when no reader that started before should need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE_EVERY = 20


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers of the complete folders of a kind, ascending."""
    store, path = _files(spark, folder)
    if not store.exists(path):
        return []
    found = []
    for status in store.listStatus(path):
        name = status.getPath().getName()
        if name.startswith(f"{kind}=") and store.exists(_files(spark, f"{folder}/{name}/_SUCCESS")[1]):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def live(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int | None, list[int]]:
    """The newest base and the batches after it; of those before a batch, if one is named."""
    within = lambda n: before is None or n < before
    bases = [n for n in _numbers(spark, folder, "base") if within(n)]
    base = bases[-1] if bases else None
    return base, [n for n in _numbers(spark, folder, "batch") if within(n) and (base is None or n > base)]


def folders(spark: SparkSession, folder: str, before: int | None = None) -> list[str]:
    base, batches = live(spark, folder, before)
    return [f"{folder}/base={base}"] * (base is not None) + [f"{folder}/batch={n}" for n in batches]


def read(spark: SparkSession, folder: str, schema: str | None = None, before: int | None = None) -> DataFrame:
    """The rows of the base and of the batches after it, not yet merged.

    Without a schema it is that of the files. Where nothing was written there are no rows, or an error without a schema.
    """
    found = folders(spark, folder, before)
    if not found and schema is None:
        raise ValueError(f"no batch was written to {folder} yet")
    # every folder is a root of its own: `base` and `batch` are no columns, the folders below are
    reader = spark.read.schema(schema) if schema else spark.read
    parts = [reader.parquet(f) for f in found]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge(
    spark: SparkSession, folder: str, batch: int, every: int, merged: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]
) -> None:
    """After every `every` batches, writes what `merged` gives as the new base and deletes what the base before had replaced.

    Runs inside a batch after its folder was written. If the batch is repeated, an existing base stays.
    """
    if (batch + 1) % every:
        return
    bases = _numbers(spark, folder, "base")
    if not bases or bases[-1] < batch:
        write(merged(), f"{folder}/base={batch}")
    if bases and bases[-1] <= batch:
        old = bases[-1] if bases[-1] < batch else (bases[-2] if len(bases) > 1 else -1)
        for kind, last in (("base", old - 1), ("batch", old)):
            for n in _numbers(spark, folder, kind):
                if n <= last:
                    store, path = _files(spark, f"{folder}/{kind}={n}")
                    store.delete(path, True)


def write_rows(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def first_of(key: list[str], rows: DataFrame, order: str) -> DataFrame:
    """One row a key, that with the largest `order` (a column), by a hash aggregation with partial maxima."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    last = rows.groupBy(*key).agg(F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("row"))
    return last.select(*key, order, *[F.col("row")[c].alias(c) for c in rest])
