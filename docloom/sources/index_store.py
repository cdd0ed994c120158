"""The stored index: postings by keyword, pages by document, laid out by measured size.

Postings are stored as rows, or as the lists of `index.gathered_postings`: several rows a keyword, each with many
postings, so that few rows are moved and sorted. Look-ups give the same rows from both.

A store is a folder of hash buckets. Their number is chosen from the measured data and recorded
with the store, so that a bucket holds about BUCKET_BYTES whatever the input. Files are sorted by the
key that look-ups use, keep its minimum and maximum for runs of few rows, and postings keep a Bloom
filter of their keywords. A look-up of few keys pushes them down as literals: Spark opens the
folders of these keys only, and inside a file reads the runs that may hold one. A look-up
of many keys joins, and folders are pruned at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import index

BUCKET_BYTES = 64 * 1024 * 1024
MAX_BUCKETS = 8192
LITERAL_KEYS = 400  # a look-up of more different keys joins
LITERAL_BYTES = 256 * 1024
LAYOUT = "buckets int, bytes bigint"
_POSTING_OPTIONS = {
    "parquet.bloom.filter.enabled#keyword": "true",
    "parquet.bloom.filter.expected.ndv#keyword": "100000",
    "parquet.block.size": 16 * 1024 * 1024,
    "parquet.page.row.count.limit": 256,
}
# Texts are long: a page of the file holds a few of them, so that a hit does not read its neighbours.
_PAGE_OPTIONS = {"parquet.page.size": 16 * 1024, "parquet.page.row.count.limit": 4, "parquet.block.size": 32 * 1024 * 1024}


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(size: int) -> int:
    """The power of two of buckets of about BUCKET_BYTES, between one and MAX_BUCKETS."""
    return min(MAX_BUCKETS, 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length())


def _write(df: DataFrame, folder: str, bucket_column: str, sort_by: list[str], options: dict, buckets: int) -> None:
    """The rebalance splits a bucket above the session's advisory size into several tasks and files."""
    (
        df.withColumn(bucket_column, bucket(F.col(sort_by[0]), buckets))
        .hint("rebalance", bucket_column)
        .sortWithinPartitions(bucket_column, *sort_by)
        .write.mode("overwrite")
        .options(**options)
        .partitionBy(bucket_column)
        .parquet(folder)
    )


def record_layout(spark: SparkSession, folder: str, buckets: int, size: int) -> None:
    spark.createDataFrame([(buckets, size)], LAYOUT).coalesce(1).write.mode("overwrite").json(f"{folder}/layout")


def buckets_of(spark: SparkSession, folder: str) -> int:
    """The number of buckets recorded with a store."""
    return spark.read.schema(LAYOUT).json(f"{folder}/layout").first()["buckets"]


def write_posting_files(postings: DataFrame, folder: str, buckets: int) -> None:
    """Postings by keyword bucket, sorted by keyword, rows also by document and page."""
    order = ["keyword"] if "refs" in postings.columns else ["keyword", "doc_id", "page_number"]
    _write(postings, folder, "keyword_bucket", order, _POSTING_OPTIONS, buckets)


def measure(pages: DataFrame) -> tuple[int, int]:
    """Pages, and bytes of their texts. Postings of a text take about as much room as the text."""
    return tuple(pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first())


def write_postings(postings: DataFrame, folder: str, size: int) -> None:
    """A new posting store. postings: keyword, doc_id, page_number and more, or lists; size: bytes of the texts they come from."""
    buckets = buckets_for(size)
    write_posting_files(postings, f"{folder}/data", buckets)
    record_layout(postings.sparkSession, folder, buckets, size)


def write_pages(pages: DataFrame, folder: str, size: int) -> None:
    """A new page store. pages: doc_id, page_number, text and more; size: bytes of the texts."""
    buckets = buckets_for(size)
    _write(pages, f"{folder}/data", "page_bucket", ["doc_id", "page_number"], _PAGE_OPTIONS, buckets)
    record_layout(pages.sparkSession, folder, buckets, size)


def few_keys(keys: DataFrame) -> list[str] | None:
    """The different keys of a one-column table in order; None above LITERAL_KEYS keys or LITERAL_BYTES bytes.

    At most LITERAL_KEYS + 1 rows come to the driver.
    """
    column = keys.columns[0]
    rows = keys.filter(F.col(column).isNotNull()).distinct().limit(LITERAL_KEYS + 1).collect()
    found = sorted(r[0] for r in rows)
    return found if len(found) <= LITERAL_KEYS and sum(map(len, found)) <= LITERAL_BYTES else None


def _literal(key: str) -> str:
    return f"cast(X'{key.encode().hex()}' as string)"


def _is_any(column: str, keys: list[str]) -> Column:
    """Equality with one of the keys, as a balanced tree: a long IN is pushed down as one range only.

    Rows pass the hashed list first; the equalities are for the files' statistics and Bloom filters.
    """
    if not keys:
        return F.lit(False)
    terms = [f"{column} = {_literal(k)}" for k in keys]
    while len(terms) > 1:
        terms = [f"({' or '.join(terms[i : i + 2])})" for i in range(0, len(terms), 2)]
    return F.expr(f"{column} in ({', '.join(map(_literal, keys))})") & F.expr(terms[0])


def with_keys(stored: DataFrame, column: str, bucket_column: str, buckets: int, keys: DataFrame) -> DataFrame:
    """The rows of stored files with one of the keys (one column); few keys are pushed down, many are joined."""
    few = few_keys(keys)
    if few is None:
        named = keys.select(F.col(keys.columns[0]).alias(column)).filter(F.col(column).isNotNull()).distinct()
        named = named.withColumn(bucket_column, bucket(F.col(column), buckets))
        return stored.join(named, [bucket_column, column], "left_semi").drop(bucket_column)
    spark = stored.sparkSession
    rows = spark.createDataFrame([(k,) for k in few], f"{column} string").select(bucket(F.col(column), buckets)).distinct().collect()
    folders = sorted(r[0] for r in rows)
    return stored.filter(F.col(bucket_column).isin(folders) & _is_any(column, few)).drop(bucket_column)


def read_postings(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    """The stored postings of the given keywords (terms: keyword)."""
    found = with_keys(
        spark.read.parquet(f"{folder}/data"), "keyword", "keyword_bucket", buckets_of(spark, folder), terms.select("keyword")
    )
    return index.scattered(found) if "refs" in found.columns else found


def read_pages(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The stored pages of the given documents (wanted: doc_id)."""
    return with_keys(
        spark.read.parquet(f"{folder}/data"), "doc_id", "page_bucket", buckets_of(spark, folder), wanted.select("doc_id")
    )
