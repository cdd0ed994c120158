"""Keyword retrieval for many queries at once.

Input queries: query_id, query. All joins are equi joins on keyword or page. Ranking
keeps k rows per query before its shuffle, and page text is read only for those rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import text as tx
from docloom.operators.sizing import broadcast_if_bounded, broadcast_if_small
from docloom.session import with_checkpoints

# Pages, or what gives the pages of the documents in a table of doc_id (a page store)
Pages = DataFrame | Callable[[DataFrame], DataFrame]

# ids, score, keyword and position of one ranked page, with room to spare
_RANKED_ROW_BYTES = 4096


def _with_synonyms(words: Column) -> Column:
    table = F.create_map(
        *chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in fv.SYNONYMS.items())
    )
    extra = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), tx.no_strings())))
    return F.array_distinct(F.concat(words, extra))


def query_terms(queries: DataFrame, synonyms: bool = True) -> DataFrame:
    """query_id, term_no, keyword, n_terms: the distinct search terms of each query in alphabetical order."""
    words = tx.keywords(F.col("query"))
    terms = F.array_sort(_with_synonyms(words) if synonyms else words)
    return queries.select("query_id", terms.alias("terms")).select(
        "query_id", F.posexplode("terms").alias("term_no", "keyword"), F.size("terms").alias("n_terms")
    )


def term_postings(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """The postings of every query term."""
    return postings.join(broadcast_if_small(terms), "keyword")


# The posting that provides a page's snippet is the most relevant one, on a tie the one of
# the alphabetically first term. Relevance steps, term number and (capped) snippet length
# share one number whose minimum finds it, so that the aggregation stays hash-based.
_STEPS, _TERM_BITS, _LENGTH_BITS = 10, 32, 16


def _snippet_rank() -> Column:
    steps = F.lit(_STEPS) - F.round(F.col("relevance") * _STEPS).cast("bigint")
    number = F.shiftleft(F.shiftleft(steps, _TERM_BITS) + F.col("term_no"), _LENGTH_BITS)
    return number


def _snippet_term(code: Column) -> Column:
    return F.shiftright(code, _LENGTH_BITS).bitwiseAND(F.lit((1 << _TERM_BITS) - 1)).cast("int")


def _snippet_length(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))


def matched_pages(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Summed relevance per query and page, with the number of the term that provides the snippet."""
    best = _snippet_rank()
    if "snippet_chars" in postings.columns:
        best = best + F.least("snippet_chars", F.lit(2 * fv.SNIPPET_SIDE_CHARS))
    return (
        term_postings(terms, postings)
        .groupBy("query_id", "doc_id", "page_number")
        .agg(
            F.round(F.sum("relevance"), 6).alias("score"),
            F.count("*").alias("terms_found"),
            F.max("n_terms").alias("n_terms"),
            F.min(best).alias("best"),
        )
    )


def snippet_terms(matched: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds the keyword that provides each row's snippet."""
    names = broadcast_if_small(terms.select("query_id", "term_no", "keyword"))
    return matched.withColumn("term_no", _snippet_term(F.col("best"))).join(names, ["query_id", "term_no"]).drop("term_no")


def rank_pages(matched: DataFrame, k: int | None = None, by: str = "score") -> DataFrame:
    """Rank within each query by score, then document and page; keep the first k."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id", "page_number")
    ranked = matched.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def rank_all_pages(matched: DataFrame, by: str = "score") -> DataFrame:
    """The rank of every matched page of every query, in the order of `rank_pages`.

    Rows are dealt to ranges of (query, score, document, page), so that a query that matches all
    pages is ranked by all tasks. A row's number inside its range is added to the query's rows in the
    ranges before; only one row a query and range is summed up for that. Placed rows are written once, because
    numbers and offsets must come from the same ranges.
    """
    with_checkpoints(matched.sparkSession)
    order = ["query_id", F.desc(by), "doc_id", "page_number"]
    placed = matched.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).checkpoint()
    parts = placed.groupBy("query_id", "range").agg(F.count("*").alias("n"), F.min("place").alias("start"))
    before = Window.partitionBy("query_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("query_id", "range", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = (F.col("before") + F.col("place") - F.col("start") + 1).alias("rank")
    return placed.join(broadcast_if_small(parts), ["query_id", "range"]).select(*matched.columns, rank)


def signal_scores(matched: DataFrame) -> DataFrame:
    """Weighted relevance, term coverage and snippet quality.

    Snippet quality has no published definition; here it is the share of a full
    200-character snippet, at most 1.
    """
    weight = fv.SIGNAL_WEIGHTS
    coverage = F.col("terms_found") / F.col("n_terms")
    quality = F.least(_snippet_length(F.col("best")) / F.lit(200.0), F.lit(1.0))
    total = (
        F.col("score") * F.lit(weight["relevance"])
        + coverage * F.lit(weight["coverage"])
        + quality * F.lit(weight["snippet"])
    )
    return matched.withColumn("signal_score", F.round(total, 6))


def ranked_pages(top: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per query: its ranked pages (at most k) and their mean score."""
    page = F.struct("rank", "doc_id", "page_number", "score", "keyword")
    return snippet_terms(top, terms).groupBy("query_id").agg(
        F.sort_array(F.collect_list(page)).alias("ranked_pages"),
        F.avg("score").alias("mean_score"),
    )


def confidence(ranked: DataFrame) -> DataFrame:
    """Mean score of the ranked pages plus a bonus per page, at most 1."""
    n = F.size("ranked_pages")
    bonus = F.least(n * F.lit(fv.CONFIDENCE_PER_PAGE), F.lit(fv.CONFIDENCE_PAGE_CAP))
    return ranked.withColumn("confidence", F.round(F.least(F.col("mean_score") + bonus, F.lit(1.0)), 6))


def _pages_of(pages: Pages, wanted: DataFrame) -> DataFrame:
    """All pages of a table; of a page store those of the wanted documents (doc_id)."""
    return pages if isinstance(pages, DataFrame) else pages(wanted.select("doc_id"))


def settled(few: DataFrame, pages: Pages) -> DataFrame:
    """Rows that choose pages, computed once: a page store is asked for them before they are joined."""
    if isinstance(pages, DataFrame):
        return few
    with_checkpoints(few.sparkSession)
    return few.checkpoint()


def _on_pages(ranked: DataFrame, pages: Pages, n_queries: int, k: int) -> DataFrame:
    """Join the few ranked rows to their pages; rows without such a page are dropped."""
    rows = ranked.select("query_id", F.inline("ranked_pages"))
    side = broadcast_if_bounded(rows, n_queries * k, _RANKED_ROW_BYTES)
    return _pages_of(pages, rows).select("doc_id", "page_number", "source_file", "text").join(side, ["doc_id", "page_number"])


def _joined(parts: DataFrame, part: Column) -> DataFrame:
    collected = F.sort_array(F.collect_list(F.struct("rank", part.alias("part"))))
    return parts.groupBy("query_id").agg(
        F.array_join(F.transform(collected, lambda s: s["part"]), "\n\n").alias("context")
    )


def context(ranked: DataFrame, pages: Pages, n_queries: int, k: int = fv.DEFAULT_TOP_PAGES) -> DataFrame:
    """Labelled snippets of the ranked pages, one text per query (at most k parts each).

    Of a page store only the pages of the ranked documents are read; give it `settled` rows.
    """
    part = F.concat(
        F.lit("[Document: "), tx.base_name(F.col("source_file")),
        F.lit(", Page "), F.col("page_number"), F.lit("]\n"),
        tx.snippet_at(F.col("text"), F.instr(F.lower("text"), F.col("keyword")), F.col("keyword")),
    )
    return _joined(_on_pages(ranked, pages, n_queries, k), part)


def page_context(ranked: DataFrame, pages: Pages, n_queries: int, k: int = fv.DEFAULT_TOP_PAGES) -> DataFrame:
    """Like `context`, with the first 1000 characters of the page in place of the snippet."""
    part = F.concat(
        F.lit("[Document: "), F.col("source_file"), F.lit(", Page "), F.col("page_number"), F.lit("]\n"),
        F.substring(tx.or_empty(F.col("text")), 1, 1000),
    )
    return _joined(_on_pages(ranked, pages, n_queries, k), part)


def match_counts(matched: DataFrame) -> DataFrame:
    """Matching pages per query before ranking, and the best score.

    It reads the columns ranking reads, so that both can share one shuffle.
    """
    return matched.groupBy("query_id").agg(
        F.count("best").alias("matched_pages"), F.max("score").alias("best_score")
    )


_PARTS = 1024


def counted_top(terms: DataFrame, postings: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `rank_pages` up to k, and those of `match_counts`, from one pass over the postings.

    Pages are dealt to parts by their hash; within a part each query's pages are ranked and counted where they lie. Only k
    rows a query and part leave it, the first of them with the part's counts.
    """
    with_checkpoints(postings.sparkSession)
    part = F.pmod(F.xxhash64("doc_id", "page_number"), F.lit(_PARTS)).alias("part")
    dealt = term_postings(terms, postings.select("*", part).repartition("part"))
    matched = dealt.groupBy("query_id", "part", "doc_id", "page_number").agg(
        F.round(F.sum("relevance"), 6).alias("score"), F.min(_snippet_rank()).alias("best")
    )
    own = Window.partitionBy("query_id", "part")
    placed = matched.withColumns({
        "place": F.row_number().over(own.orderBy(F.desc("score"), "doc_id", "page_number")), "pages": F.count("best").over(own)
    })
    first = placed.filter(F.col("place") <= k).drop("part").checkpoint()
    counts = first.filter("place = 1").groupBy("query_id").agg(F.sum("pages").alias("matched_pages"), F.max("score").alias("best_score"))
    return rank_pages(first.drop("place", "pages"), k), counts


def answer(queries: DataFrame, postings: DataFrame, pages: Pages, k: int = fv.DEFAULT_TOP_PAGES) -> DataFrame:
    """Matched pages, ranked pages, confidence and context for every query, also those without a match."""
    n_queries = queries.count()
    terms = query_terms(queries)
    if isinstance(pages, DataFrame):
        matched = matched_pages(terms, postings).drop("terms_found", "n_terms")
        top, counts = rank_pages(matched, k), match_counts(matched)
    else:  # settled rows end the plan that ranks, so that counting could not share its shuffle
        top, counts = counted_top(terms, postings, k)
    ranked = settled(confidence(ranked_pages(top, terms)), pages)
    return (
        queries.join(counts, "query_id", "left")
        .join(ranked.drop("mean_score"), "query_id", "left")
        .join(context(ranked, pages, n_queries, k), "query_id", "left")
        .fillna({"matched_pages": 0, "best_score": 0.0, "confidence": 0.0, "context": ""})
    )


def keyword_lookup(lookups: DataFrame, postings: DataFrame, pages: Pages, first: int = 5) -> DataFrame:
    """Exact keyword lookup: total hits, and the first references in document order with their snippets.

    Input lookups: keyword. Text is read only for the few references shown.
    """
    wanted = lookups.select(F.lower("keyword").alias("keyword")).distinct()
    found = postings.join(broadcast_if_small(wanted), "keyword")
    totals = found.groupBy("keyword").agg(F.count("*").alias("total_hits"))
    order = Window.partitionBy("keyword").orderBy("doc_id", "page_number")
    refs = found.withColumn("ref", F.row_number().over(order)).filter(F.col("ref") <= first)
    shown = refs.join(totals, "keyword").select("keyword", "total_hits", "ref", "doc_id", "page_number", "position")
    shown = settled(shown, pages)
    side = broadcast_if_bounded(shown, wanted.count() * first, _RANKED_ROW_BYTES)
    snippet = F.substring(tx.snippet_at(F.col("text"), F.col("position"), F.col("keyword")), 1, 200)
    texts = _pages_of(pages, shown).select("doc_id", "page_number", "text")
    return texts.join(side, ["doc_id", "page_number"]).select(
        "keyword", "total_hits", "ref", "doc_id", "page_number", snippet.alias("snippet")
    )
