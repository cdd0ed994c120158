"""Uploaded archives: one archive is one job."""

from __future__ import annotations

import io
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import text as tx

# Ship this helper with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBER_SCHEMA = (
    "job_id string, archive_size bigint, member_path string, member_size bigint, header binary,"
    " inner_names array<string>, archive_error string"
)


# All that damaged bytes raise while an archive or a member is read.
DAMAGED = (
    zipfile.BadZipFile, zlib.error, struct.error, EOFError, ValueError, RuntimeError, OSError, NotImplementedError,
)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of every ZIP file below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def list_samples(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """file_name and size_mb by name, from file metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        tx.base_name(F.col("path")).alias("file_name"),
        F.round(F.col("length") / 1048576, 1).alias("size_mb"),
    ).orderBy("file_name")


def _inner_names(archive: zipfile.ZipFile, info: zipfile.ZipInfo, head: bytes) -> list[str] | None:
    """Member names of a nested archive, read as a stream and never held whole."""
    if not head.startswith(b"PK\x03\x04"):
        return None
    try:
        with archive.open(info) as stream, zipfile.ZipFile(stream) as inner:
            return inner.namelist()
    except DAMAGED:
        return None


def _member_row(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple:
    try:
        with archive.open(info) as stream:
            head = stream.read(16)
        return info.filename, info.file_size, head, _inner_names(archive, info, head), None
    except DAMAGED as broken:
        return info.filename, info.file_size, None, None, f"unreadable member: {broken}"


def _within_limits(infos: list[zipfile.ZipInfo], size: int) -> bool:
    """The limits on members and ratio, judged from the archive's directory alone."""
    unpacked = sum(info.file_size for info in infos)
    return len(infos) <= fv.MAX_ARCHIVE_MEMBERS and unpacked <= size * fv.MAX_COMPRESSION_RATIO


def _archive_rows(content: bytes, size: int) -> list[tuple]:
    """Rows without job_id and size; members of an archive beyond the limits are listed but not opened."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
            if not _within_limits(infos, size):
                return [(info.filename, info.file_size, None, None, None) for info in infos]
            return [_member_row(archive, info) for info in infos] or [(None, None, None, None, None)]
    except DAMAGED as broken:
        return [(None, None, None, None, f"invalid or corrupted archive: {broken}")]


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One manifest row per member; a member is read only as far as its first bytes or its own member list."""
    columns = [part.split()[0] for part in MEMBER_SCHEMA.split(", ")]
    for batch in batches:
        for job_id, size, content in zip(batch["job_id"], batch["length"], batch["content"]):
            rows = [(job_id, size, *row) for row in _archive_rows(content, size)]
            yield pd.DataFrame(rows, columns=columns)


def with_job_id(archives: DataFrame) -> DataFrame:
    return archives.withColumn("job_id", F.regexp_replace(tx.base_name(F.col("path")), r"\.zip$", ""))


def expand_archives(archives: DataFrame) -> DataFrame:
    """The member manifest; an unreadable archive gives one row with archive_error, an empty one a row without path.

    Archives beyond the size limit are not opened: `check_archives` rejects them by size.
    """
    within = archives.filter(F.col("length") <= fv.MAX_ARCHIVE_BYTES)
    inputs = with_job_id(within).select("job_id", "length", "content")
    return inputs.mapInPandas(_members, MEMBER_SCHEMA)


def archive_table(archives: DataFrame) -> DataFrame:
    return with_job_id(archives).select("job_id", F.col("length").alias("archive_size"))
