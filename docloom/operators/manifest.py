"""Archive checks, member paths and file classification.

Input manifest: job_id, member_path, member_size, header (first bytes, binary); optional
sniffed_mime, inner_names (member names of a nested archive) and archive_error. A row without
member_path stands for the archive itself: with an error it could not be read, without one it
is empty. An error on a row with a path is that member's. Input archives:
job_id, archive_size. Everything works on rows of all jobs together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import text as tx
from docloom.functions.lookup import lookup


def _error(manifest: DataFrame) -> Column:
    return F.col("archive_error") if "archive_error" in manifest.columns else F.lit(None).cast("string")


def check_archives(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    """job_id, members, unpacked_bytes, reject_reason (null when accepted); first failed limit wins.

    An archive without any manifest row, or with an error of its own, is corrupt; a readable one
    without members is accepted.
    """
    broken = F.col("member_path").isNull() & _error(manifest).isNotNull()
    totals = manifest.groupBy("job_id").agg(
        F.count("member_path").alias("members"),
        F.sum("member_size").alias("unpacked_bytes"),
        F.coalesce(F.bool_or(broken), F.lit(False)).alias("broken"),
    )
    size = F.col("archive_size")
    ratio = F.col("unpacked_bytes") / size
    reason = (
        F.when(size.isNull(), "archive not found")
        .when(size > fv.MAX_ARCHIVE_BYTES, "archive size exceeds maximum")
        .when(F.col("members").isNull() | F.col("broken"), "invalid or corrupted archive")
        .when(F.col("members") > fv.MAX_ARCHIVE_MEMBERS, "too many files in archive")
        .when((size > 0) & (ratio > fv.MAX_COMPRESSION_RATIO), "suspicious compression ratio")
    )
    return archives.join(totals, "job_id", "left").select(
        "job_id", "archive_size", "members", "unpacked_bytes", reason.alias("reject_reason")
    )


def safe_path(path: Column) -> Column:
    """A relative path with single forward slashes, or null for a dangerous one."""
    relative = F.regexp_replace(path, r"^[/\\]+", "")
    dangerous = F.contains(relative, F.lit("..")) | relative.rlike(r"(?s)^.:")
    clean = F.regexp_replace(F.translate(relative, "\\", "/"), "/{2,}", "/")
    return F.when(~dangerous & ~clean.isin("", "."), clean)


def with_safe_path(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("path", safe_path(F.col("member_path")))


def accepted_members(manifest: DataFrame) -> DataFrame:
    """Members that become files: readable, safe path, not a directory, at least one byte."""
    return with_safe_path(manifest).filter(
        F.col("path").isNotNull() & _error(manifest).isNull() & ~F.endswith("member_path", F.lit("/")) & (F.col("member_size") > 0)
    )


def member_errors(manifest: DataFrame) -> DataFrame:
    """job_id, member_path, error for unreadable archives (no path) and members, dangerous paths, empty files."""
    checked = with_safe_path(manifest)
    empty = ~F.endswith("member_path", F.lit("/")) & (F.col("member_size") <= 0)
    own = _error(manifest)
    error = F.when(own.isNotNull(), own).when(
        F.col("path").isNull(), F.concat(F.lit("Skipped dangerous path: "), "member_path")
    ).when(empty, F.concat(F.lit("Empty file: "), "path"))
    return checked.select("job_id", "member_path", error.alias("error")).filter("error is not null")


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def type_by_extension(path: Column) -> Column:
    return lookup(fv.TYPE_BY_EXTENSION, extension(path))


def type_by_mime(mime: Column) -> Column:
    return lookup(fv.TYPE_BY_MIME, mime)


def type_by_magic(header: Column, path: Column, inner_names: Column | None = None) -> Column:
    """Type from the first sixteen bytes; archives look at the extension, then at their member names."""
    first = F.hex(F.substring(header, 1, 16))
    names = tx.no_strings() if inner_names is None else F.coalesce(inner_names, tx.no_strings())

    def holds(folder: str) -> Column:
        return F.exists(names, lambda name: F.contains(name, F.lit(folder)))

    packed = F.coalesce(
        type_by_extension(path), F.when(holds("word/"), "docx").when(holds("xl/"), "xlsx")
    )
    kind = F.when(F.length(first) > 24, lookup(fv.RIFF_KIND, F.substring(first, 17, 8)))
    found = F.when(F.startswith(first, F.lit(fv.ZIP_MAGIC)), packed).when(
        F.startswith(first, F.lit(fv.RIFF_MAGIC)), kind
    )
    for prefix, file_type in fv.TYPE_BY_MAGIC.items():
        found = found.when(F.startswith(first, F.lit(prefix)), file_type)
    return found


def guessed_mime(path: Column) -> Column:
    return lookup(fv.MIME_BY_EXTENSION, extension(path))


def category(file_type: Column) -> Column:
    found = F
    for name, types in fv.CATEGORY_TYPES.items():
        found = found.when(file_type.isin(types), name)
    return found.otherwise("unknown")


def is_supported(file_type: Column) -> Column:
    return file_type != "unknown"


def file_id(job_id: Column, path: Column) -> Column:
    """Stable across reruns."""
    digest = F.sha2(F.concat_ws("\n", job_id, path), 256)
    return F.concat(F.lit("file_"), F.substring(digest, 1, 12))


def classify_files(members: DataFrame) -> DataFrame:
    """Files with type, category, MIME type and id, from members with a safe path."""
    path = F.col("path")
    sniffed = F.col("sniffed_mime") if "sniffed_mime" in members.columns else F.lit(None).cast("string")
    inner = F.col("inner_names") if "inner_names" in members.columns else None
    file_type = F.coalesce(
        type_by_mime(sniffed),
        type_by_extension(path),
        type_by_magic(F.col("header"), path, inner),
        type_by_mime(guessed_mime(path)),
        F.lit("unknown"),
    )
    typed = members.withColumn("file_type", file_type)
    known_sniffed = F.when(type_by_mime(sniffed).isNotNull(), sniffed)
    return typed.select(
        "job_id",
        file_id(F.col("job_id"), path).alias("file_id"),
        "path",
        tx.base_name(path).alias("file_name"),
        F.col("member_size").alias("file_size"),
        "file_type",
        category(F.col("file_type")).alias("category"),
        F.when(is_supported(F.col("file_type")), F.coalesce(known_sniffed, guessed_mime(path))).alias("mime_type"),
    )


def discover(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of all accepted archives."""
    accepted = check_archives(archives, manifest).filter("reject_reason is null").select("job_id")
    return classify_files(accepted_members(manifest).join(accepted, "job_id", "left_semi"))


def discovery_summary(files: DataFrame) -> DataFrame:
    """Counts per category, files and bytes of each job."""
    names = [*fv.CATEGORY_TYPES, "unknown"]
    return files.groupBy("job_id").agg(
        *[F.count_if(F.col("category") == name).alias(f"{name}_count") for name in names],
        F.count("*").alias("total_files"),
        F.sum("file_size").alias("total_bytes"),
        F.round(F.sum("file_size") / (1024 * 1024), 2).alias("total_mb"),
    )


def directory_nodes(files: DataFrame) -> DataFrame:
    """Adjacency rows of the directory tree: every prefix of every path once per job."""
    parts = F.split("path", "/")
    steps = files.select(
        "job_id", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")
    )
    here = F.array_join(F.expr("slice(parts, 1, depth)"), "/")
    above = F.when(F.col("depth") > 0, F.array_join(F.expr("slice(parts, 1, depth - 1)"), "/"))
    nodes = steps.select(
        "job_id",
        here.alias("path"),
        F.when(F.col("depth") > 0, above).alias("parent_path"),
        F.when(F.col("depth") > 0, F.expr("parts[depth - 1]")).otherwise(F.lit("root")).alias("name"),
        "depth",
        (F.col("depth") == F.size("parts")).alias("is_file"),
    )
    return nodes.groupBy("job_id", "path", "parent_path", "name", "depth").agg(
        F.bool_and("is_file").alias("is_file")
    )
