"""Documents, their pages and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import text as tx
from docloom.operators.sizing import broadcast_if_small


def parseable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("file_type").isin(fv.CATEGORY_TYPES["document"]))


def non_blank_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(tx.strip(F.col("text")) != "")


def corpus_stats(pages: DataFrame) -> DataFrame:
    """Totals of documents, pages, tables and images."""
    return pages.agg(
        F.countDistinct("doc_id").alias("documents"),
        F.count("*").alias("pages"),
        F.sum(F.size("tables")).alias("tables"),
        F.sum(F.size("images")).alias("images"),
    )


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHMMSS with an ignored zone offset; null when it does not parse."""
    digits = F.substring(F.get(F.split(F.replace(value, F.lit("D:"), F.lit("")), "[+-]"), F.lit(0)), 1, 14)
    return F.when(
        digits.rlike(r"^\d{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))
    )


def _page_text() -> Column:
    return F.concat(F.lit("[Page "), "page_number", F.lit("]\n"), "text")


def full_text(pages: DataFrame, pages_per_part: int = 1000, chars_per_part: int = 16_000_000) -> DataFrame:
    """doc_id, part, text: labelled non-blank pages in order.

    A document of up to pages_per_part page numbers and chars_per_part characters is one row. A longer one
    goes on in further parts: a run of page numbers is cut where its characters pass another chars_per_part, so no
    row exceeds that and one page. The whole text is the parts in order, joined by a blank line. Only documents
    of several parts are numbered, from page lengths; texts pass one shuffle.
    """
    run = F.floor((F.col("page_number") - 1) / pages_per_part).alias("run")
    before = Window.partitionBy("doc_id", "run").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum("chars").over(before), F.lit(0)) / chars_per_part)
    labelled = non_blank_pages(pages).select("doc_id", "page_number", run, _page_text().alias("t"))
    placed = labelled.withColumn("chars", F.length("t")).withColumn("cut", cut)
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "t")))
    parts = placed.groupBy("doc_id", "run", "cut").agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n\n").alias("text"))
    lengths = labelled.select("doc_id", "page_number", "run", F.length("t").alias("chars")).withColumn("cut", cut)
    several = lengths.groupBy("doc_id").agg(F.count_distinct("run", "cut").alias("n")).filter("n > 1")
    names = lengths.join(several, "doc_id", "left_semi").select("doc_id", "run", "cut").distinct()
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "cut")) - 1
    names = broadcast_if_small(names.select("doc_id", "run", "cut", number.alias("number")))
    numbered = parts.join(names, ["doc_id", "run", "cut"], "left")
    return numbered.select("doc_id", F.coalesce("number", F.lit(0)).cast("bigint").alias("part"), "text")


def text_start(pages: DataFrame, chars: int) -> DataFrame:
    """doc_id, text: the first characters of each document's full text.

    A labelled page takes at least a dozen characters, so only the first pages can
    matter: the rank limit keeps those before the shuffle, however long a document is.
    """
    shortest = len("[Page 1]\nx\n\n")
    enough = chars // shortest + 1
    order = Window.partitionBy("doc_id").orderBy("page_number")
    first = (
        non_blank_pages(pages)
        .select("doc_id", "page_number", F.substring(_page_text(), 1, chars).alias("t"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= enough)
    )
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "t"))), lambda p: p["t"]), "\n\n"
    )
    return first.groupBy("doc_id").agg(F.substring(joined, 1, chars).alias("text"))


def _text_chars() -> Column:
    """Length of a document's stripped full text, as an aggregate over its pages."""
    text = F.col("text")
    filled = F.coalesce(tx.strip(text) != "", F.lit(False))
    label = F.length(F.concat(F.lit("[Page "), "page_number", F.lit("]\n")))
    tail = F.length(text) - F.length(F.rtrim(text, F.lit(tx.BLANKS)))
    pages = F.count_if(filled)
    total = F.sum(F.when(filled, label + F.length(text))) + (pages - 1) * 2
    return total - F.max_by(tail, F.when(filled, F.col("page_number")))


def text_chars(pages: DataFrame) -> DataFrame:
    """doc_id, chars: length of the stripped full text, without building it; blank documents are left out."""
    return pages.groupBy("doc_id").agg(_text_chars().alias("chars")).filter("chars is not null")


def service_candidates(pages: DataFrame) -> DataFrame:
    """doc_id, doc_name, chars of documents named .pdf or .docx with at least a hundred characters of text."""
    documents = pages.groupBy("doc_id").agg(
        tx.base_name(F.min("source_file")).alias("doc_name"), _text_chars().alias("chars")
    )
    named = F.endswith("doc_name", F.lit(".pdf")) | F.endswith("doc_name", F.lit(".docx"))
    return documents.filter(named & (F.col("chars") >= fv.MIN_SERVICE_TEXT_CHARS))
