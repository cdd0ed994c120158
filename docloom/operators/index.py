"""Inverted index over pages, tables and images.

Input pages: doc_id, source_file, page_number, text. Postings are rows, never one
list per keyword, so a keyword found on a third of all pages is still many small
rows. Text is used only where keywords are taken from it and is not carried on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.hits import keyword_hit_lists, keyword_hits, keyword_snippets
from docloom.functions.lookup import bound
from docloom.operators.sizing import fits_broadcast
from docloom.session import with_checkpoints

NAMED_TERMS = 10_000  # terms that a scan of the pages looks for by name


def page_keywords(pages: DataFrame) -> DataFrame:
    """One row per keyword of a page."""
    return pages.select("doc_id", "page_number", F.explode(tx.keywords(F.col("text"))).alias("keyword"))


def _with_keywords(pages: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, text, keyword (array): all keywords of a page, or those among the terms if these are not too many to name."""
    found = pages.select("doc_id", "page_number", "text", tx.keywords(F.col("text")).alias("keyword"))
    if terms is None:
        return found
    named = terms.select("keyword").filter("keyword is not null").distinct().limit(NAMED_TERMS + 1).collect()
    if len(named) > NAMED_TERMS:
        return found
    wanted = sorted(r["keyword"] for r in named)
    return found.withColumn("keyword", F.filter("keyword", lambda w: w.isin(wanted)))


def postings(pages: DataFrame, with_snippet_length: bool = False, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, keyword, relevance, position (and snippet_chars), without a shuffle.

    With terms (keyword) only postings that a join with the terms needs are sure to be made: a text is not searched for the
    other keywords. Up to NAMED_TERMS different terms come to the driver for that.
    """
    found = with_relevance(keyword_hits(_with_keywords(pages, terms), with_snippet_length))
    columns = ["doc_id", "page_number", "keyword", "relevance", "position"]
    return found.select(*columns, *["snippet_chars"] * with_snippet_length)


def gathered_postings(pages: DataFrame) -> DataFrame:
    """keyword, refs: all postings of the pages in lists, many of a keyword to a row; `scattered` gives the postings."""
    return keyword_hit_lists(_with_keywords(pages))


def scattered(gathered: DataFrame) -> DataFrame:
    """The postings in lists as rows: the other columns of the lists, then doc_id, page_number, keyword, relevance, position."""
    others = [c for c in gathered.columns if c not in ("keyword", "refs")]
    rows = with_relevance(gathered.select(*others, "keyword", F.inline("refs")))
    return rows.select(*others, "doc_id", "page_number", "keyword", "relevance", "position")


def with_relevance(hits: DataFrame) -> DataFrame:
    """Adds the relevance of postings given by keyword, hits and position."""
    return hits.withColumn("relevance", tx.relevance(F.col("keyword"), F.col("hits"), F.col("position")))


def posting_snippets(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, keyword, snippet."""
    return keyword_snippets(_with_keywords(pages))


def keyword_counts(pages: DataFrame) -> DataFrame:
    """keyword, pages: in how many pages each keyword occurs."""
    return page_keywords(pages).groupBy("keyword").agg(F.count("*").alias("pages"))


_SALTS = 64


def posting_lists(postings_df: DataFrame, segment_rows: int = 100_000) -> DataFrame:
    """keyword, segment, refs: posting lists in segments of about segment_rows.

    A rare keyword is one list. A frequent one is spread over as many segments as its count needs,
    by a hash of the page, so no group grows with the data. Postings are made once and written;
    counts come from them, with partial sums, and only the frequent keywords are joined: broadcast where
    their measured number allows, else by keyword and salt.
    """
    with_checkpoints(postings_df.sparkSession)
    page_hash = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "page_number")), 1, 8), 16, 10).cast("bigint")
    made = postings_df.select("keyword", "doc_id", "page_number", "relevance").checkpoint()
    counts = made.groupBy("keyword").agg(F.count("*").alias("pages"))
    segments = F.ceil(F.col("pages") / segment_rows).alias("segments")
    frequent = counts.filter(F.col("pages") > segment_rows).select("keyword", segments)
    placed = made.withColumn("page_hash", page_hash)
    if fits_broadcast(frequent):
        placed = placed.join(F.broadcast(frequent), "keyword", "left")
    else:
        everywhere = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = placed.withColumn("salt", (F.col("page_hash") % _SALTS).cast("int"))
        placed = salted.join(everywhere, ["keyword", "salt"], "left").drop("salt")
    placed = placed.withColumn("segment", F.col("page_hash") % F.coalesce("segments", F.lit(1)))
    ref = F.struct("doc_id", "page_number", "relevance")
    return placed.groupBy("keyword", "segment").agg(F.sort_array(F.collect_list(ref)).alias("refs"))


def document_nodes(pages: DataFrame) -> DataFrame:
    """One tree node per document; its keywords stay rows in `node_keywords`."""
    head = F.substring(tx.or_empty(F.col("text")), 1, 500)
    return pages.groupBy("doc_id").agg(
        tx.base_name(F.min("source_file")).alias("title"),
        F.lit(1).cast("bigint").alias("start_page"),
        F.count("*").alias("end_page"),
        F.concat(F.lit("Document with "), F.count("*"), F.lit(" pages")).alias("summary"),
        F.min_by(head, "page_number").alias("content_snippet"),
    )


def node_keywords(pages: DataFrame) -> DataFrame:
    """Distinct keywords of each document, longer than two characters."""
    return page_keywords(pages).select("doc_id", "keyword").distinct()


def index_tree(pages: DataFrame) -> DataFrame:
    """The root row and its document rows as an adjacency table."""
    documents = pages.groupBy("doc_id").agg(tx.base_name(F.min("source_file")).alias("title"))
    nodes = documents.select(
        F.col("doc_id").alias("node_id"), F.lit("root").alias("parent_id"), "title", F.lit(1).alias("depth")
    )
    count = pages.agg(F.countDistinct("doc_id").alias("n"))
    root = count.filter("n > 0").select(
        F.lit("root").alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.concat(F.lit("Index containing "), "n", F.lit(" documents")).alias("title"),
        F.lit(0).alias("depth"),
    )
    return nodes.unionByName(root)


def table_postings(tables: DataFrame) -> DataFrame:
    """keyword rows for headers and the first five data rows of each table."""
    header_text = F.array_join("headers", " ")
    body_text = F.array_join(F.flatten(F.slice("rows", 1, 5)), " ")
    both = F.array_union(bound(header_text, tx.keywords), bound(body_text, tx.keywords))
    return tables.select(
        F.explode(both).alias("keyword"),
        "table_id",
        "source_doc",
        "source_page",
        "table_type",
        "headers",
        F.substring(tx.or_empty(F.col("context")), 1, 200).alias("snippet"),
    )


def media_postings(images: DataFrame, analyses: DataFrame) -> DataFrame:
    """keyword rows for the description of each image; images without one have none."""
    described = images.join(analyses.select("image_id", "description", "category"), "image_id", "left")
    return described.select(
        F.explode(tx.keywords(F.col("description"))).alias("keyword"),
        "image_id",
        "file_path",
        F.coalesce("category", F.lit("unknown")).alias("category"),
        "source_doc",
        F.substring(tx.or_empty(F.col("description")), 1, 200).alias("description"),
    )


def _one_row(*parts: DataFrame) -> DataFrame:
    """Single-row tables side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def index_stats(pages: DataFrame, tables: DataFrame, images: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals of an index in one row. The keyword count is exact unless asked otherwise."""
    count_keywords = F.approx_count_distinct if approximate else F.countDistinct
    keywords = page_keywords(pages).agg(count_keywords("keyword").alias("total_keywords"))
    docs = pages.agg(F.countDistinct("doc_id").alias("total_documents"))
    one_row = docs.withColumn(
        "total_tree_nodes",
        F.when(F.col("total_documents") > 0, F.col("total_documents") + 1).otherwise(F.lit(0)),
    )
    return _one_row(
        one_row,
        tables.agg(F.count("*").alias("total_tables")),
        images.agg(F.count("*").alias("total_images")),
        keywords,
    )


def keyword_stats(pages: DataFrame) -> DataFrame:
    """Documents, pages, distinct keywords and mean keywords per page."""
    per_page = pages.select("doc_id", "page_number", tx.keywords(F.col("text")).alias("keyword"))
    totals = per_page.agg(
        F.countDistinct("doc_id").alias("total_documents"),
        F.count("*").alias("total_pages"),
        F.round(F.avg(F.size("keyword")), 6).alias("avg_keywords_per_page"),
    )
    distinct = page_keywords(pages).agg(F.countDistinct("keyword").alias("total_keywords"))
    return _one_row(totals, distinct)


SKETCH_LOG_SIZE = 14  # 16,384 registers: a standard error of about 0.8 %, so nearly always within 2.5 %


def stats_sketch(pages: DataFrame) -> DataFrame:
    """One row that stands for a batch of pages: page and keyword totals, and sketches of its documents and keywords.

    Rows of several batches are merged by `merged_stats`; an append reads its own pages only.
    """
    words = pages.select("doc_id", F.posexplode_outer(tx.keywords(F.col("text"))).alias("place", "keyword"))
    return words.agg(
        F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("pages"),
        F.count("keyword").alias("page_keywords"),
        F.hll_sketch_agg("doc_id", F.lit(SKETCH_LOG_SIZE)).alias("documents"),
        F.hll_sketch_agg("keyword", F.lit(SKETCH_LOG_SIZE)).alias("keywords"),
    )


def merged_stats(sketches: DataFrame) -> DataFrame:
    """total_documents, total_pages, total_keywords, avg_keywords_per_page over batches; the two distinct counts are estimates.

    A page that is in two batches counts twice in the totals and once in the estimates. `keyword_stats` is exact.
    """
    whole = sketches.agg(
        F.hll_union_agg("documents").alias("documents"), F.hll_union_agg("keywords").alias("keywords"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"), F.sum("page_keywords").alias("page_keywords"),
    )
    return whole.select(
        F.hll_sketch_estimate("documents").alias("total_documents"), "total_pages",
        F.round(F.try_divide("page_keywords", "total_pages"), 6).alias("avg_keywords_per_page"),
        F.hll_sketch_estimate("keywords").alias("total_keywords"),
    )


def compress(postings_df: DataFrame, keep: int = 10) -> DataFrame:
    """The best postings of each keyword; the rank limit is applied before the shuffle as well."""
    best_first = Window.partitionBy("keyword").orderBy(F.desc("relevance"), "doc_id", "page_number")
    return postings_df.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= keep)


def keyword_frequency(pages: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent keywords by number of pages."""
    return keyword_counts(pages).orderBy(F.desc("pages"), "keyword").limit(limit)
