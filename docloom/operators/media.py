"""Images: union, dedup, quality, summaries and their analyses.

Input images: image_id, seq (input order), job_id, source_doc, source_page, width, height,
file_size, mime_type, extraction_method, is_embedded, image_hash, file_path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.lookup import lookup


def content_hash(content: Column) -> Column:
    return F.md5(content)


def all_images(embedded: DataFrame, standalone: DataFrame) -> DataFrame:
    """Embedded images before standalone ones; seq stays the order inside each part."""
    return embedded.withColumn("part", F.lit(0)).unionByName(
        standalone.withColumn("part", F.lit(1)), allowMissingColumns=True
    )


def drop_duplicates(images: DataFrame) -> DataFrame:
    """The first image of each hash in a job; a frequent hash is cut to one row before the shuffle."""
    order = ["part", "seq"] if "part" in images.columns else ["seq"]
    first = Window.partitionBy("job_id", "image_hash").orderBy(*order)
    return images.withColumn("n", F.row_number().over(first)).filter(F.col("n") == 1).drop("n")


def duplicate_counts(images: DataFrame) -> DataFrame:
    """Images, distinct hashes and removed duplicates per job."""
    per_hash = images.groupBy("job_id", "image_hash").agg(F.count("*").alias("n"))
    return per_hash.groupBy("job_id").agg(
        F.sum("n").alias("images"),
        F.count("*").alias("unique_images"),
        (F.sum("n") - F.count("*")).alias("duplicates_removed"),
    )


def _ratio() -> Column:
    return F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(1.0))


def _ratio_gap() -> Column:
    ratios = F.array(*map(F.lit, fv.STANDARD_RATIOS))
    return F.array_min(F.transform(ratios, lambda r: F.abs(r - _ratio())))


def _by_pixels(levels: list[tuple], value: int) -> Column:
    pixels = F.col("width").cast("bigint") * F.col("height")
    found = F
    for level in levels:
        found = found.when(pixels >= level[0], F.lit(level[value]))
    return found


def with_quality(images: DataFrame) -> DataFrame:
    """resolution, standard_ratio and quality_score from the pixel size."""
    standard = _ratio_gap() < 0.1
    base = _by_pixels(fv.RESOLUTION_LEVELS, 2)
    return images.select(
        "*",
        _by_pixels(fv.RESOLUTION_LEVELS, 1).alias("resolution"),
        standard.alias("standard_ratio"),
        F.when(standard, F.least(base + F.lit(0.1), F.lit(1.0))).otherwise(base).alias("quality_score"),
    )


def with_alternative_quality(images: DataFrame) -> DataFrame:
    """resolution_score and ratio_score on the second published scale."""
    gap = _ratio_gap()
    return images.select(
        "*",
        _by_pixels(fv.ALTERNATIVE_RESOLUTION_SCORES, 1).alias("resolution_score"),
        F.when(gap < 0.1, F.lit(1.0)).when(gap < 0.2, F.lit(0.8)).otherwise(F.lit(0.6)).alias("ratio_score"),
    )


def extraction_summary(images: DataFrame) -> DataFrame:
    """Embedded and standalone images, duplicates and bytes per job."""
    counts = images.groupBy("job_id").agg(
        F.count_if("is_embedded").alias("embedded_count"),
        F.count_if(~F.col("is_embedded")).alias("standalone_count"),
        F.sum("file_size").alias("total_size_bytes"),
    )
    return counts.join(duplicate_counts(images).select("job_id", "duplicates_removed"), "job_id")


def image_format(file_name: Column, default: str = "jpg") -> Column:
    suffix = F.lower(F.regexp_extract(file_name, r"[^/]\.([^./]+)$", 1))
    return F.coalesce(lookup(fv.IMAGE_FORMATS, suffix), F.lit(default))


def with_analysis(images: DataFrame, analyses: DataFrame) -> DataFrame:
    """Images and their analyses matched on image_id."""
    return images.join(analyses, "image_id")


def product_images(analyses: DataFrame) -> DataFrame:
    return analyses.filter("is_product")


def service_images(analyses: DataFrame) -> DataFrame:
    return analyses.filter("is_service_related")


def count_by_category(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("category").agg(F.count("*").alias("images"))
