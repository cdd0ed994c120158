"""Continuous indexing: pages that arrive become postings, pages that arrive again replace theirs.

A batch writes three tables, each kept as a base and the batches since (`batches`): `arrivals`, the hash
of the text of each page it indexed; `replaced`, the pages among these that the index already had; and
`postings` by keyword bucket, in lists as in `index_store`, with the batch they come from. A posting counts
unless its page was replaced in a later batch; lists since the last batch that replaced a page are not looked into. A page whose text is the one indexed last
is not indexed again, whenever it comes. Merging drops the postings that no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.hits import gathered_hits
from docloom.operators import index
from docloom.operators.sizing import broadcast_if_small
from docloom.session import with_checkpoints
from docloom.sources import index_store
from docloom.streaming import batches

PAGE = ["doc_id", "page_number"]
ARRIVALS = "doc_id string, page_number bigint, batch bigint, text_hash bigint"
REPLACED = "doc_id string, page_number bigint, batch bigint"
POSTINGS = (
    "keyword string, refs array<struct<doc_id: string, page_number: bigint, hits: int, position: int>>, batch bigint, keyword_bucket int"
)
EXPECTED_BYTES = 64 * 1024 * 1024


def arrived_now(pages: DataFrame) -> DataFrame:
    """Arrival time from the file's modification time."""
    return pages.withColumn("arrived_at", F.col("_metadata.file_modification_time"))


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def changed_pages(batch: DataFrame, arrivals: DataFrame) -> DataFrame:
    """doc_id, page_number, text_hash, known, text: the pages of a batch that the index lacks or has with another text.

    Of a page that comes several times in the batch the last arrival counts, on a tie the text with the largest hash.
    """
    batch = batch.filter(F.col("doc_id").isNotNull() & F.col("page_number").isNotNull())
    last = batch.groupBy(*PAGE).agg(F.max_by("text", F.struct("arrived_at", _text_hash())).alias("text"))
    last = last.withColumn("text_hash", _text_hash())
    had = batches.first_of(PAGE, arrivals, "batch").select(*PAGE, F.col("text_hash").alias("before"), F.lit(True).alias("known"))
    found = last.join(had, PAGE, "left").filter(F.col("known").isNull() | (F.col("text_hash") != F.col("before")))
    return found.select(*PAGE, "text_hash", F.coalesce("known", F.lit(False)).alias("known"), "text")


def last_replacement(replaced: DataFrame) -> int:
    return replaced.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def standing(lists: DataFrame, replaced: DataFrame, latest: int) -> tuple[DataFrame, DataFrame]:
    """Lists in which every posting counts, and the postings that count of older lists: doc_id, page_number, keyword, hits, position."""
    last = replaced.groupBy(*PAGE).agg(F.max("batch").alias("replaced_at"))
    old = lists.filter(F.col("batch") < latest).select("keyword", "batch", F.inline("refs"))
    joined = old.join(broadcast_if_small(last), PAGE, "left")
    counted = joined.filter(F.col("replaced_at").isNull() | (F.col("batch") >= F.col("replaced_at")))
    return lists.filter(F.col("batch") >= latest), counted.select(*PAGE, "keyword", "hits", "position")


def standing_lists(lists: DataFrame, replaced: DataFrame) -> DataFrame:
    """keyword, refs, batch: the postings that count, in lists."""
    latest = last_replacement(replaced)
    whole, rows = standing(lists, replaced, latest)
    batch = F.lit(latest).cast("bigint").alias("batch")
    return whole.select("keyword", "refs", "batch").unionByName(gathered_hits(rows).select("keyword", "refs", batch))


def start_ingest(
    pages: DataFrame, folder: str, checkpoint: str, merge_every: int = batches.MERGE_EVERY, expected_bytes: int = EXPECTED_BYTES
) -> StreamingQuery:
    """Keep an index of the pages (doc_id, page_number, text, arrived_at) of a stream in a folder.

    expected_bytes: text bytes the index is sized for; the number of buckets is recorded with the first
    start and stays. A repeated batch writes the same files again.
    """
    spark = pages.sparkSession
    with_checkpoints(spark)
    if not batches.live(spark, f"{folder}/postings")[1] and not batches.live(spark, f"{folder}/postings")[0]:
        index_store.record_layout(spark, folder, index_store.buckets_for(expected_bytes), expected_bytes)
    buckets = index_store.buckets_of(spark, folder)
    area = {name: f"{folder}/{name}" for name in ("arrivals", "replaced", "postings")}

    def write_postings(rows: DataFrame, into: str) -> None:
        index_store.write_posting_files(rows.drop("keyword_bucket"), into, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = F.lit(batch_id).cast("bigint").alias("batch")
        changed = changed_pages(batch, batches.read(spark, area["arrivals"], ARRIVALS, batch_id)).checkpoint()
        write_postings(index.gathered_postings(changed).select("keyword", "refs", number), f"{area['postings']}/batch={batch_id}")
        batches.write_rows(changed.filter("known").select(*PAGE, number), f"{area['replaced']}/batch={batch_id}")
        batches.write_rows(changed.select(*PAGE, number, "text_hash"), f"{area['arrivals']}/batch={batch_id}")
        upto = lambda name, schema: batches.read(spark, area[name], schema, batch_id + 1)
        # postings first: the pages replaced until now are dropped from the base, then their list starts anew
        whole = {
            "postings": lambda: standing_lists(upto("postings", POSTINGS), upto("replaced", REPLACED)),
            "replaced": lambda: upto("replaced", REPLACED).filter(F.col("batch") > batch_id),
            "arrivals": lambda: batches.first_of(PAGE, upto("arrivals", ARRIVALS), "batch"),
        }
        for name, merged in whole.items():
            batches.merge(
                spark, area[name], batch_id, merge_every, merged, write_postings if name == "postings" else batches.write_rows
            )

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_postings(spark: SparkSession, folder: str, terms: DataFrame | None = None) -> DataFrame:
    """The postings that count: all, or those of the given keywords (terms: keyword), pruned as in `index_store`.

    Read it anew after a merge: it names the folders that were there when it was called.
    """
    stored = batches.read(spark, f"{folder}/postings", POSTINGS)
    if terms is not None:
        buckets = index_store.buckets_of(spark, folder)
        stored = index_store.with_keys(stored, "keyword", "keyword_bucket", buckets, terms.select("keyword"))
    replaced = batches.read(spark, f"{folder}/replaced", REPLACED)
    whole, rows = standing(stored.select("keyword", "refs", "batch"), replaced, last_replacement(replaced))
    columns = [*PAGE, "keyword", "relevance", "position"]
    return index.scattered(whole).select(*columns).unionByName(index.with_relevance(rows).select(*columns))
