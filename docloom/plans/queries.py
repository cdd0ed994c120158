"""One query per operator over the driver tables.

Keys are operator ids with a short name. Every query reads whole tables through
`views`; results are flat columns so that they can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import (
    answers,
    association,
    documents,
    index,
    jobs,
    manifest,
    media,
    near_duplicates,
    profiles,
    prompts,
    retrieval,
    tables,
    validation,
)
from docloom.operators.numbering import number_rows
from docloom.plans import views
from docloom.session import new_folder
from docloom.sources import csv_tables, edit_store, index_store, stores
from docloom.streaming import ingest, job_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def big(column: Column | str, name: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint").alias(name)


def joined(column: Column | str, name: str, separator: str = " ") -> Column:
    return F.array_join(column, separator).alias(name)


def near(column: Column | str, name: str) -> Column:
    """A sum or mean of doubles, equal in any order of addition."""
    return F.round(column, 9).alias(name)


def sorted_text(column: Column | str, name: str) -> Column:
    return F.array_join(F.array_sort(column), " ").alias(name)


# --- sources and sinks ---------------------------------------------------------


@query
def src4_profile_json(spark, d):
    saved = views.profiles(spark, d)
    folder = new_folder(spark, "profiles")
    stores.save_profiles(saved, folder)
    loaded = stores.load_profiles(spark, folder, saved.schema)
    return loaded.select(
        "profile_id", "job_id", "business_type", F.col("business_info.name").alias("name"),
        F.col("business_info.contact.email").alias("email"), F.col("business_info.location.city").alias("city"),
    )


def _files(spark, d):
    return manifest.discover(views.archives(spark, d), views.members(spark, d))


@query
def src5_discovery_store(spark, d):
    folder = new_folder(spark, "discovery")
    files = _files(spark, d)
    for _ in range(2):  # a job written again replaces its records
        stores.write_discovery(files, folder)
    return stores.read_records(spark, folder, files.schema).select("job_id", "path", "file_type", "file_size")


@query
def src6_files_by_category(spark, d):
    folder = new_folder(spark, "categories")
    files = _files(spark, d)
    for _ in range(2):
        stores.write_by_category(files, folder)
    return stores.read_records(spark, folder, files.schema).select("category", "job_id", "path", "file_size")


@query
def src7_export(spark, d):
    items = views.service_maps(spark, d)
    exported = items.select("profile_id", "ordinal", profiles.export_json(F.col("item")).alias("json"))
    return exported.select(
        "profile_id", "ordinal", F.get_json_object("json", "$.name").alias("name"),
        F.get_json_object("json", "$._internal").alias("internal"),
        big(F.size(F.json_object_keys("json")), "keys"),
    )


@query
def src8_csv_rows(spark, d):
    """Customers with line breaks in quoted cells, and wider files of a hundred suppliers each, read back row by row."""
    folder = new_folder(spark, "csv")
    broken = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_mktsegment", F.lit("\n, "), "c_name")).otherwise(F.col("c_mktsegment"))
    lines = views.table(spark, d, "customer").select("c_custkey", "c_name", broken.alias("c_mktsegment"))
    lines.write.option("header", True).csv(f"{folder}/lines")
    file = F.floor(F.col("s_suppkey") / 100)
    wide = views.table(spark, d, "supplier").withColumn("file", file).repartition("file").sortWithinPartitions("file", "s_suppkey")
    cells = ["s_suppkey", "s_name", F.concat("s_name", F.lit(" Ltd")).alias("long"), "s_nationkey", F.col("s_nationkey").alias("again")]
    wide.select(*cells, "file").write.partitionBy("file").csv(f"{folder}/wide")
    rows = csv_tables.read_csv_rows(spark, [f"{folder}/lines", f"{folder}/wide"])
    cell = lambda n: F.get("cells", F.lit(n))
    return rows.filter(cell(1) != "c_name").select(
        cell(1).alias("name"), cell(2).alias("segment"), big(F.size("cells"), "n_cells"),
        F.when(F.size("cells") == 5, F.col("row_index")).alias("row_index"),
    )


# --- manifest and files ----------------------------------------------------------


def _with_damage(spark, d):
    """Archives and members, and one small archive a supplier: unreadable, empty, or with a member that cannot be read."""
    made = views.table(spark, d, "supplier").select(
        F.concat(F.lit("archive_"), "s_suppkey").alias("job_id"),
        F.when(F.col("s_suppkey") % 3 == 2, F.lit("docs/a.pdf")).alias("member_path"),
        F.when(F.col("s_suppkey") % 3 == 2, F.lit(9)).cast("bigint").alias("member_size"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("invalid or corrupted archive: no directory"))
        .when(F.col("s_suppkey") % 3 == 2, F.lit("unreadable member: bad checksum")).alias("archive_error"),
    )
    sizes = made.select("job_id", F.lit(1000).cast("bigint").alias("archive_size"))
    members = views.members(spark, d).unionByName(made, allowMissingColumns=True)
    return views.archives(spark, d).unionByName(sizes), members


@query
def fil1_archive_limits(spark, d):
    return manifest.check_archives(*_with_damage(spark, d))


@query
def fil2_safe_path(spark, d):
    return manifest.with_safe_path(views.members(spark, d)).select("job_id", "member_path", "path")


@query
def fil3_member_errors(spark, d):
    return manifest.member_errors(_with_damage(spark, d)[1])


@query
def fil4_type_by_extension(spark, d):
    path = F.col("path")
    return manifest.with_safe_path(views.members(spark, d)).filter("path is not null").select(
        "path", manifest.extension(path).alias("extension"), manifest.type_by_extension(path).alias("file_type")
    )


@query
def fil5_type_by_mime(spark, d):
    members = views.members(spark, d)
    return members.select("member_path", "sniffed_mime", manifest.type_by_mime(F.col("sniffed_mime")).alias("file_type"))


@query
def fil6_type_by_magic(spark, d):
    kind = manifest.type_by_magic(F.col("header"), F.col("member_path"), F.col("inner_names"))
    return views.members(spark, d).select("member_path", F.hex("header").alias("header"), kind.alias("file_type"))


@query
def fil7_classify(spark, d):
    accepted = manifest.accepted_members(views.members(spark, d))
    return manifest.classify_files(accepted).select("job_id", "path", "file_type", "mime_type")


@query
def fil8_category(spark, d):
    accepted = manifest.accepted_members(views.members(spark, d))
    return manifest.classify_files(accepted).select("job_id", "path", "category")


@query
def fil9_supported(spark, d):
    files = manifest.classify_files(manifest.accepted_members(views.members(spark, d)))
    return files.filter(manifest.is_supported(F.col("file_type"))).select("job_id", "path", "file_type")


@query
def fil10_empty_files(spark, d):
    errors = manifest.member_errors(views.members(spark, d))
    return errors.filter(F.startswith("error", F.lit("Empty file: ")))


@query
def fil11_summary(spark, d):
    return manifest.discovery_summary(_files(spark, d))


@query
def fil12_directory_nodes(spark, d):
    nodes = manifest.directory_nodes(_files(spark, d))
    return nodes.select("job_id", "path", "parent_path", "name", big("depth", "depth"), "is_file")


@query
def fil13_file_ids(spark, d):
    return _files(spark, d).select("job_id", "path", "file_id")


# --- documents -------------------------------------------------------------------


@query
def prj1_parseable(spark, d):
    return documents.parseable(_files(spark, d)).select("job_id", "path", "file_type")


@query
def prj2_non_blank_pages(spark, d):
    return documents.non_blank_pages(views.pages(spark, d)).select("doc_id", "page_number")


@query
def prj3_service_candidates(spark, d):
    return documents.service_candidates(views.pages(spark, d))


@query
def prj4_corpus_stats(spark, d):
    return documents.corpus_stats(views.table_pages(spark, d))


@query
def prj5_base_names(spark, d):
    return views.pages(spark, d).select("doc_id", "page_number", tx.base_name(F.col("source_file")).alias("file_name"))


@query
def prj6_images_by_category(spark, d):
    found = views.analyses(spark, d)
    return media.count_by_category(found).join(
        media.count_by_category(media.product_images(found)).withColumnRenamed("images", "product_images"),
        "category", "left",
    )


@query
def prj7_pricing_tables(spark, d):
    found = tables.tables_of_type(tables.extract_tables(views.table_pages(spark, d)), "pricing")
    return found.select("table_id", "table_type", joined("headers", "headers", "|"))


@query
def dat1_pdf_dates(spark, d):
    stamp = F.concat(
        F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"),
        F.when(F.col("o_orderkey") % 4 == 0, "T1").otherwise("112233+05'30'"),
    )
    orders = views.table(spark, d, "orders").select("o_orderkey", stamp.alias("stamp"))
    return orders.select(
        "o_orderkey", F.date_format(documents.pdf_date(F.col("stamp")), "yyyy-MM-dd HH:mm:ss").alias("created")
    )


# --- tables ------------------------------------------------------------------------


def _rows_text(column: str, name: str) -> Column:
    rows = F.transform(column, lambda r: F.array_join(r, "|", "~"))
    return F.array_join(rows, "/", "~").alias(name)


@query
def tab1_raw_tables(spark, d):
    raw = tables.raw_tables(views.table_pages(spark, d))
    return raw.select("table_id", big("table_index", "table_index"), _rows_text("raw", "raw"))


def _cleaned(spark, d):
    raw = tables.raw_tables(views.table_pages(spark, d))
    return raw.withColumn("table", tables.clean_rows(F.col("raw")))


@query
def tab2_clean_tables(spark, d):
    return _cleaned(spark, d).select("table_id", _rows_text("table", "cells"))


@query
def tab3_valid_tables(spark, d):
    return _cleaned(spark, d).select("table_id", tables.is_valid(F.col("table")).alias("valid"))


@query
def tab4_plausible_tables(spark, d):
    raw = tables.raw_tables(views.table_pages(spark, d))
    return raw.select("table_id", tables.is_plausible(F.col("raw")).alias("plausible"))


@query
def tab5_even_width(spark, d):
    return _cleaned(spark, d).select("table_id", tables.has_even_width(F.col("table")).alias("even"))


def _test(spark, d, test):
    return _cleaned(spark, d).select("table_id", F.coalesce(test(F.col("table")), F.lit(False)).alias("matches"))


@query
def tab6_pricing(spark, d):
    return _test(spark, d, tables.is_pricing)


@query
def tab7_itinerary(spark, d):
    return _test(spark, d, tables.is_itinerary)


@query
def tab8_specifications(spark, d):
    return _test(spark, d, tables.is_specification)


@query
def tab9_menu(spark, d):
    return _test(spark, d, tables.is_menu)


@query
def tab10_inventory(spark, d):
    return _test(spark, d, tables.is_inventory)


@query
def tab11_classify(spark, d):
    return tables.extract_tables(views.table_pages(spark, d)).select("table_id", "table_type")


@query
def tab12_structure(spark, d):
    found = tables.extract_tables(views.table_pages(spark, d))
    return found.select(
        "table_id", "source_doc", "source_page", joined("headers", "headers", "|"), _rows_text("rows", "rows"), "context"
    )


@query
def tab13_confidence(spark, d):
    return tables.extract_tables(views.table_pages(spark, d)).select("table_id", "confidence")


@query
def tab14_count_by_type(spark, d):
    return tables.count_by_type(tables.extract_tables(views.table_pages(spark, d)))


@query
def tab15_shape(spark, d):
    found = tables.extract_tables(views.table_pages(spark, d))
    return found.select("table_id", big("row_count", "row_count"), big("column_count", "column_count"))


# --- keywords ------------------------------------------------------------------------


def _of_pages(spark, d, column: Column):
    return views.pages(spark, d).select("doc_id", "page_number", column)


@query
def kw1_tokens(spark, d):
    return _of_pages(spark, d, sorted_text(tx.tokens(F.col("text")), "tokens"))


@query
def kw2_without_stopwords(spark, d):
    exploded = views.pages(spark, d).select("doc_id", "page_number", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return exploded.groupBy("token").agg(F.count("*").alias("pages"))


@query
def kw3_emails(spark, d):
    return _of_pages(spark, d, joined(tx.emails(F.col("text")), "emails"))


@query
def kw4_phones(spark, d):
    return _of_pages(spark, d, joined(tx.phones(F.col("text")), "phones"))


@query
def kw5_urls(spark, d):
    crawled = views.table(spark, d, "pages")
    return crawled.select("page_id", joined(tx.urls(F.concat_ws(" ", "url", "html")), "urls"))


@query
def kw6_prices(spark, d):
    priced = F.concat(F.lit("Item "), "p_name", F.lit(" at $"), F.floor("p_retailprice"), F.lit(".50 each"))
    return views.table(spark, d, "part").select("p_partkey", joined(tx.prices(priced), "prices"))


@query
def kw7_ngrams(spark, d):
    shown = lambda words, n: F.array_join(tx.ngrams(words, n), " ")
    runs = F.transform(F.array(tx.tokens(F.col("text"))), lambda words: F.struct(
        shown(words, 2).alias("bigrams"), shown(words, 3).alias("trigrams")
    ))
    return views.pages(spark, d).select("doc_id", "page_number", F.inline(runs))


@query
def kw8_keywords(spark, d):
    return _of_pages(spark, d, sorted_text(tx.keywords(F.col("text")), "keywords"))


@query
def kw9_capitalised(spark, d):
    return views.pages(spark, d).select("doc_id", "page_number", joined(tx.capitalised_words(F.col("text")), "names"))


# --- index ---------------------------------------------------------------------------


@query
def idx1_page_postings(spark, d):
    return index.page_keywords(views.pages(spark, d))


_STORES: dict[tuple[str, str], str] = {}


def _stored(spark, d):
    """A folder with the postings and pages of d, written once a session: index once, look up often."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        folder, pages = new_folder(spark, "index"), views.pages(spark, d)
        _, size = index_store.measure(pages)
        index_store.write_postings(index.gathered_postings(pages), f"{folder}/postings", size)
        index_store.write_pages(pages, f"{folder}/pages", size)
        _STORES[key] = folder
    return _STORES[key]


def _stored_postings(spark, d, terms):
    return index_store.read_postings(spark, f"{_stored(spark, d)}/postings", terms)


def _stored_pages(spark, d):
    folder = _stored(spark, d)
    return lambda wanted: index_store.read_pages(spark, f"{folder}/pages", wanted)


@query
def idx1_stored_postings(spark, d):
    """Index once, then look up the postings of all query terms in the stored index."""
    terms = _terms(spark, d)
    found = retrieval.term_postings(terms, _stored_postings(spark, d, terms))
    return found.select("query_id", "keyword", "doc_id", "page_number", F.round("relevance", 6).alias("relevance"))


@query
def idx2_relevance(spark, d):
    found = index.postings(views.pages(spark, d))
    return found.select("doc_id", "page_number", "keyword", F.round("relevance", 6).alias("relevance"),
                        big("position", "position"))


@query
def idx3_snippets(spark, d):
    return index.posting_snippets(views.pages(spark, d))


@query
def idx4_posting_lists(spark, d):
    lists = index.posting_lists(index.postings(views.pages(spark, d)), segment_rows=200)
    refs = F.transform("refs", lambda r: F.concat_ws(":", r["doc_id"], r["page_number"]))
    return lists.select("keyword", big("segment", "segment"), joined(refs, "refs"))


@query
def idx5_document_nodes(spark, d):
    pages = views.pages(spark, d)
    sizes = index.node_keywords(pages).groupBy("doc_id").agg(F.count("*").alias("keywords"))
    return index.document_nodes(pages).join(sizes, "doc_id", "left").fillna(0, ["keywords"])


@query
def idx6_tree(spark, d):
    nodes = index.index_tree(views.pages(spark, d))
    return nodes.select("node_id", "parent_id", "title", big("depth", "depth"))


@query
def idx7_table_postings(spark, d):
    found = index.table_postings(tables.extract_tables(views.table_pages(spark, d)))
    return found.select("keyword", "table_id", "source_page", "table_type", joined("headers", "headers", "|"), "snippet")


@query
def idx8_media_postings(spark, d):
    return index.media_postings(views.images(spark, d), views.analyses(spark, d))


@query
def idx9_index_stats(spark, d):
    found = tables.extract_tables(views.table_pages(spark, d))
    return index.index_stats(views.pages(spark, d), found, views.images(spark, d))


@query
def idx10_keyword_stats(spark, d):
    return index.keyword_stats(views.pages(spark, d))


@query
def idx11_compress(spark, d):
    best = index.compress(index.postings(views.pages(spark, d)).withColumn("relevance", F.round("relevance", 6)))
    return best.select("keyword", big("rank", "rank"), "doc_id", "page_number", "relevance")


@query
def idx12_keyword_frequency(spark, d):
    return index.keyword_frequency(views.pages(spark, d))


# --- retrieval -------------------------------------------------------------------------


def _terms(spark, d):
    return retrieval.query_terms(views.questions(spark, d))


def _matched(spark, d, with_length=False):
    terms = _terms(spark, d)
    return retrieval.matched_pages(terms, index.postings(views.pages(spark, d), with_length, terms))


def _ranked(spark, d):
    return retrieval.ranked_pages(retrieval.rank_pages(_matched(spark, d), 5), _terms(spark, d))


@query
def ret1_query_terms(spark, d):
    return retrieval.query_terms(views.questions(spark, d), synonyms=False).select(
        "query_id", "keyword", big("n_terms", "n_terms")
    )


@query
def ret2_synonyms(spark, d):
    return _terms(spark, d).select("query_id", "keyword", big("n_terms", "n_terms"))


@query
def ret3_term_postings(spark, d):
    terms = _terms(spark, d)
    found = retrieval.term_postings(terms, index.postings(views.pages(spark, d), terms=terms))
    return found.select("query_id", "keyword", "doc_id", "page_number", F.round("relevance", 6).alias("relevance"))


@query
def ret4_page_scores(spark, d):
    named = retrieval.snippet_terms(_matched(spark, d), _terms(spark, d))
    return named.select("query_id", "doc_id", "page_number", "score", F.col("keyword").alias("best_keyword"))


@query
def ret5_ranking(spark, d):
    return retrieval.rank_all_pages(_matched(spark, d)).select("query_id", "doc_id", "page_number", big("rank", "rank"))


@query
def ret6_topk_pages(spark, d):
    top = retrieval.rank_pages(_matched(spark, d), 5)
    return top.select("query_id", big("rank", "rank"), "doc_id", "page_number", "score")


def _stored_ranked(spark, d):
    """The ranked pages of all questions from the stored index, and the page store to read them from."""
    terms, pages = _terms(spark, d), _stored_pages(spark, d)
    matched = retrieval.matched_pages(terms, _stored_postings(spark, d, terms))
    return retrieval.settled(retrieval.ranked_pages(retrieval.rank_pages(matched, 5), terms), pages), pages


@query
def ret7_context(spark, d):
    ranked, pages = _stored_ranked(spark, d)
    return retrieval.context(ranked, pages, views.questions(spark, d).count())


@query
def ret8_confidence(spark, d):
    known = retrieval.confidence(_ranked(spark, d)).select("query_id", "confidence")
    return views.questions(spark, d).select("query_id").join(known, "query_id", "left").fillna(0.0, ["confidence"])


@query
def ret9_match_counts(spark, d):
    counts = retrieval.match_counts(_matched(spark, d)).select("query_id", "matched_pages")
    return views.questions(spark, d).select("query_id").join(counts, "query_id", "left").fillna(0, ["matched_pages"])


@query
def ret10_keyword_lookup(spark, d):
    wanted = _terms(spark, d).select("keyword")
    found = retrieval.keyword_lookup(wanted, _stored_postings(spark, d, wanted), _stored_pages(spark, d))
    return found.select("keyword", "total_hits", big("ref", "ref"), "doc_id", "page_number", "snippet")


@query
def ret11_signal_ranking(spark, d):
    scored = retrieval.signal_scores(_matched(spark, d, with_length=True))
    top = retrieval.rank_pages(scored, 5, by="signal_score")
    return top.select("query_id", big("rank", "rank"), "doc_id", "page_number", "signal_score")


@query
def ret12_page_context(spark, d):
    ranked, pages = _stored_ranked(spark, d)
    return retrieval.page_context(ranked, pages, views.questions(spark, d).count())


@query
def retrieve_answers(spark, d):
    pages, questions = views.pages(spark, d), views.questions(spark, d)
    postings = index.postings(pages, terms=retrieval.query_terms(questions))
    return _answers(retrieval.answer(questions, postings, pages))


@query
def retrieve_stored_answers(spark, d):
    """The same answers from the stored index and the page store."""
    questions = views.questions(spark, d)
    postings = _stored_postings(spark, d, retrieval.query_terms(questions))
    return _answers(retrieval.answer(questions, postings, _stored_pages(spark, d)))


def _answers(found):
    refs = F.transform("ranked_pages", lambda p: F.concat_ws(":", p["doc_id"], p["page_number"]))
    return found.select(
        "query_id", "query", "matched_pages", "best_score", F.coalesce(F.array_join(refs, " "), F.lit("")).alias("ranked"),
        "confidence", "context",
    )


# --- images ------------------------------------------------------------------------------


@query
def med1_content_hash(spark, d):
    found = views.images(spark, d)
    return found.select("image_id", media.content_hash(F.col("content").cast("binary")).alias("hash"))


@query
def med2_drop_duplicates(spark, d):
    return media.drop_duplicates(views.images(spark, d)).select("image_id", "job_id", "image_hash")


@query
def med3_near_pairs(spark, d):
    return near_duplicates.near_pairs(views.images(spark, d))


@query
def med3_drop_near_duplicates(spark, d):
    return near_duplicates.drop_near_duplicates(views.images(spark, d)).select("job_id", "image_id")


@query
def med4_quality(spark, d):
    found = media.with_quality(views.images(spark, d))
    return found.select("image_id", "resolution", "standard_ratio", "quality_score")


@query
def med5_alternative_quality(spark, d):
    found = media.with_alternative_quality(views.images(spark, d))
    return found.select("image_id", "resolution_score", "ratio_score")


@query
def med6_summary(spark, d):
    return media.extraction_summary(views.images(spark, d))


@query
def med7_format(spark, d):
    path = F.col("file_path")
    return views.images(spark, d).select(
        "image_id", media.image_format(path).alias("format"), media.image_format(path, "unknown").alias("known_format")
    )


@query
def med8_all_images(spark, d):
    found = views.images(spark, d)
    both = media.all_images(found.filter("is_embedded"), found.filter("not is_embedded"))
    return both.select("image_id", big("part", "part"), "seq")


@query
def med9_with_analysis(spark, d):
    found = media.with_analysis(
        views.images(spark, d).select("image_id", "file_path"), views.analyses(spark, d).select("image_id", "description")
    )
    return found.select("image_id", "file_path", "description")


@query
def med10_associations(spark, d):
    return association.associate(views.items(spark, d), views.analyses(spark, d))


@query
def med11_tag_overlap(spark, d):
    pairs = views.items(spark, d).select("item_id", F.col("tags").alias("item_tags")).join(
        views.analyses(spark, d).select("image_id", "tags"), F.expr("image_id = concat('img_', item_id)")
    )
    overlap = association.tag_overlap(F.col("item_tags"), F.col("tags"))
    return pairs.select("item_id", F.round(overlap, 6).alias("overlap"))


@query
def med12_unassociated(spark, d):
    found = views.analyses(spark, d)
    # products and services are the same items here: images with either flag are looked at once
    either = found.withColumn("shown", F.coalesce("is_product", F.lit(False)) | F.coalesce("is_service_related", F.lit(False)))
    left = association.unassociated(found, association.associate(views.items(spark, d), either, "shown"))
    return left.select("job_id", "image_id")


# --- request and answer tables ---------------------------------------------------------------


def _doc_list(spark, d):
    """All files as the documents of jobs of ten conversation files, then ten document files, each."""

    def files(name, key, letter, after):
        return views.table(spark, d, name).select(
            F.concat(F.lit("job_"), F.floor(F.col(key) / 10)).alias("job_id"),
            F.concat(F.lit(letter), key).alias("doc_id"),
            (F.col(key) + F.lit(after)).alias("doc_order"),
        ).distinct()

    return files("conversations", "conv_id", "c", 0).unionByName(files("documents", "doc_id", "d", 1 << 40))


@query
def llm1_full_text(spark, d):
    return documents.full_text(views.pages(spark, d)).select("doc_id", big("part", "part"), "text")


@query
def llm2_business_type(spark, d):
    return prompts.business_type(_doc_list(spark, d), views.pages(spark, d))


@query
def llm3_company_requests(spark, d):
    return prompts.company_requests(_doc_list(spark, d), views.pages(spark, d)).select("job_id", "input")


@query
def llm4_service_requests(spark, d):
    return prompts.service_requests(views.pages(spark, d)).select("doc_id", "doc_name", "input")


@query
def llm5_image_prompts(spark, d):
    pages = views.pages(spark, d).select(F.col("doc_id").alias("source_doc"), "page_number", "text")
    placed = views.images(spark, d).withColumn("page_number", F.col("source_page")).join(
        pages, ["source_doc", "page_number"], "left"
    )
    prompt = prompts.image_prompt(F.col("text"), F.col("extraction_method"), "Describe the image.")
    return placed.select("image_id", prompt.alias("prompt"))


def _parsed(spark, d):
    return answers.parse_fenced(views.responses(spark, d))


@query
def llm6_fenced_answers(spark, d):
    return _parsed(spark, d).select(
        "doc_id",
        F.try_variant_get("data", "$.description", "string").alias("description"),
        F.try_variant_get("data", "$.policies.cancellation", "string").alias("cancellation"),
        F.try_variant_get("data", "$.price", "double").alias("price"),
    )


@query
def llm7_braced_answers(spark, d):
    given = views.responses(spark, d).filter("response is not null")
    a = F.col("analysis")
    return answers.parse_analysis(given).select(
        "image_id", a["description"].alias("description"), a["category"].alias("category"),
        joined(a["tags"], "tags"), a["is_product"].alias("is_product"), a["confidence"].alias("confidence"),
    )


@query
def llm8_categories(spark, d):
    raw = F.concat(F.lit("  "), F.upper(F.element_at(F.split("p_name", " "), 1)), F.lit(" "))
    named = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.initcap(
        F.element_at(F.array(*map(F.lit, ["product", "food", "logo", "other"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    ))).otherwise(raw)
    return views.table(spark, d, "part").select("p_partkey", answers.image_category(named).alias("category"))


@query
def llm9_analyses(spark, d):
    given = views.responses(spark, d)
    return answers.analyses(given.select("image_id"), given.select("image_id", "response", "error")).select(
        "image_id", "description", "category", "confidence"
    )


@query
def llm10_services(spark, d):
    return answers.services(_parsed(spark, d)).select(
        "doc_id", "service_id", "name", "description", "category", "base_price", "currency", "cancellation_policy",
        joined("tags", "tags"), joined("inclusions", "inclusions"), joined("exclusions", "exclusions"),
        joined(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat_ws("=", e["key"], e["value"])), "details"),
        joined(F.transform("faqs", lambda f: F.concat_ws("?", f["question"], f["answer"])), "faqs"),
    )


@query
def llm3_company_info(spark, d):
    return answers.company_info(_parsed(spark, d)).select(
        "doc_id", "name", "description", "category", "email", "phone", "website"
    )


@query
def llm11_named_services(spark, d):
    return answers.named_services(views.services(spark, d)).select("profile_id", "service_id", "name")


@query
def llm12_assembled_profiles(spark, d):
    dense = number_rows(views.services(spark, d).withColumnRenamed("ordinal", "order_key"), ["profile_id"], "order_key", "ordinal")
    docs = _doc_list(spark, d).groupBy("job_id").agg(F.count("*").alias("documents"))
    parts = profiles.profile_parts(views.profiles(spark, d), dense, docs)
    names = F.transform("services", lambda s: s["service_id"])
    return parts.select(
        "profile_id", "job_id", "business_type", "business_name", big("part", "part"),
        F.coalesce(F.array_join(names, " "), F.lit("")).alias("services"), "source_files_count", "llm_calls",
    )


@query
def llm12_whole_profiles(spark, d):
    """Profiles of all jobs from business types, company answers and the services answered for their documents."""
    docs, given = _doc_list(spark, d), views.responses(spark, d)

    def parsed(key, letters):
        """Answers about the documents or jobs there are; others are not parsed."""
        named = given.withColumn(key, F.concat(F.lit(letters), "doc_id"))
        return answers.parse_fenced(named.join(docs.select(key).distinct(), key, "left_semi"))

    companies = answers.company_info(parsed("job_id", "job_"))
    offered = answers.services(parsed("doc_id", "d"))
    types = prompts.business_type(docs, views.pages(spark, d))
    made = profiles.assemble_profiles(docs, types, companies, offered, F.lit("2024-05-01"), part_rows=4)
    info, record = F.col("business_info"), F.col("extraction_metadata")
    shown = lambda s: F.concat_ws(
        ":", s["ordinal"], s["service"]["service_id"], s["service"]["category"], s["service"]["base_price"].cast("bigint"),
        s["service"]["cancellation_policy"],
    )
    return made.select(
        "profile_id", "job_id", "business_type", info["name"].alias("name"), info["description"].alias("description"),
        info["category"].alias("category"), info["contact"]["email"].alias("email"), big("part", "part"),
        F.coalesce(F.array_join(F.transform("services", shown), " "), F.lit("")).alias("services"),
        *[record[c].alias(c) for c in (
            "extraction_date", "source_files_count", "llm_calls_made", "confidence_score", "extraction_method", "version"
        )],
    )


# --- validation ---------------------------------------------------------------------------------


def _info_field(path: str) -> Column:
    return F.col("business_info" + path)


@query
def val1_emails(spark, d):
    email = _info_field(".contact.email")
    return views.profiles(spark, d).select("profile_id", email.alias("email"), validation.is_email(email).alias("valid"))


@query
def val2_phones(spark, d):
    phone = _info_field(".contact.phone")
    return views.profiles(spark, d).select("profile_id", phone.alias("phone"), validation.is_phone(phone).alias("valid"))


@query
def val3_urls(spark, d):
    web = _info_field(".contact.website")
    return views.profiles(spark, d).select("profile_id", web.alias("website"), validation.is_web_address(web).alias("valid"))


@query
def val4_contact(spark, d):
    return validation.contact_findings(views.profiles(spark, d))


@query
def val5_info(spark, d):
    return validation.info_findings(views.profiles(spark, d))


@query
def val6_location(spark, d):
    return validation.location_findings(views.profiles(spark, d))


@query
def val7_hours(spark, d):
    return validation.hours_findings(views.profiles(spark, d))


@query
def val8_products(spark, d):
    return validation.product_findings(views.products(spark, d))


@query
def val9_services(spark, d):
    return validation.service_findings(views.services(spark, d))


@query
def val10_prices(spark, d):
    return validation.price_findings(views.services(spark, d), "services").unionByName(
        validation.price_findings(views.products(spark, d), "products")
    )


@query
def val11_missing_items(spark, d):
    return validation.missing_item_findings(views.profiles(spark, d), views.products(spark, d), views.services(spark, d))


@query
def val12_info_score(spark, d):
    return views.profiles(spark, d).select("profile_id", near(validation.info_score(), "score"))


@query
def val13_product_score(spark, d):
    means = validation.mean_scores(views.products(spark, d), validation.product_score(), "score")
    return means.select("profile_id", near("score", "score"))


@query
def val14_service_score(spark, d):
    means = validation.mean_scores(views.services(spark, d), validation.service_score(), "score")
    return means.select("profile_id", near("score", "score"))


def _field_scores(spark, d):
    return validation.field_scores(views.profiles(spark, d), views.products(spark, d), views.services(spark, d))


@query
def val15_completeness(spark, d):
    return validation.completeness(_field_scores(spark, d)).select("profile_id", near("completeness", "completeness"))


@query
def val16_field_scores(spark, d):
    scores = validation.field_score_map(_field_scores(spark, d))
    return scores.select("profile_id", F.explode("field_scores").alias("field_group", "score")).withColumn(
        "score", near("score", "score")
    )


@query
def val17_validity(spark, d):
    people = views.profiles(spark, d)
    found = validation.findings(people, views.products(spark, d), views.services(spark, d))
    return validation.validity(people, found).select("profile_id", "errors", "warnings", "is_valid")


def _jobs(spark, d):
    """One job per customer and per supplier; only customers have profiles."""
    customers = views.table(spark, d, "customer").select(F.concat(F.lit("job_"), "c_custkey").alias("job_id"))
    suppliers = views.table(spark, d, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("job_id"))
    return customers.unionByName(suppliers)


@query
def val18_missing_profiles(spark, d):
    return validation.missing_profiles(_jobs(spark, d), views.profiles(spark, d))


@query
def validate_profiles(spark, d):
    return validation.validate(
        _jobs(spark, d), views.profiles(spark, d), views.products(spark, d), views.services(spark, d)
    ).select(
        "job_id", "profile_id", "is_valid", big("errors", "errors"), big("warnings", "warnings"),
        near("completeness", "completeness"),
    )


@query
def val19_editor_completeness(spark, d):
    scores = validation.editor_completeness(views.profiles(spark, d), views.services(spark, d))
    return scores.select("profile_id", *[near(c, c) for c in ("business_info", "services", "overall")])


@query
def val19_service_scores(spark, d):
    scores = validation.editor_service_scores(views.services(spark, d))
    return scores.select("profile_id", "ordinal", near("score", "score"))


@query
def val20_service_fill(spark, d):
    filled = validation.service_fill(views.services(spark, d))
    return filled.select("profile_id", "ordinal", big("filled", "filled"), big("percent", "percent"))


@query
def val21_out_of_range(spark, d):
    items, found = views.services(spark, d), views.members(spark, d)
    return (
        validation.out_of_range(found, "member_path", "member_size", low=0, open_low=True)
        .unionByName(validation.out_of_range(items, "service_id", "base_price", low=0))
        .unionByName(validation.out_of_range(items, "service_id", "discount_price", low=0))
        .unionByName(validation.out_of_range(views.pages(spark, d), "doc_id", "page_number", low=1))
    )


@query
def val21_all_ranges(spark, d):
    """All declared ranges: the engine's own records, and ratings, scores, progress and extraction records as received."""
    rows = lambda name: views.table(spark, d, name)
    files = views.members(spark, d).withColumnRenamed("member_size", "file_size")
    found = index.postings(views.pages(spark, d)).withColumnRenamed("relevance", "relevance_score")
    analysed = answers.parse_analysis(views.responses(spark, d).filter("response is not null"))
    share = (F.col("o_totalprice") / 100000).alias("completeness_score")
    checks = [
        (files, "file", "member_path"), (views.pages(spark, d), "page", "doc_id"),
        (tables.extract_tables(views.table_pages(spark, d)), "table", "table_id"),
        (analysed.select("image_id", F.col("analysis.confidence").alias("confidence")), "analysis", "image_id"),
        (found, "posting", "doc_id"), (views.services(spark, d), "pricing", "service_id"),
        (rows("supplier").select("s_suppkey", (F.col("s_acctbal") / 1500).alias("average_rating")), "business", "s_suppkey"),
        (rows("customer").select("c_custkey", (F.col("c_acctbal") / 8000).alias("confidence_score")), "extraction", "c_custkey"),
        (rows("orders").select("o_orderkey", share), "scores", "o_orderkey"),
        (rows("lineitem").select("l_orderkey", (F.col("l_extendedprice") / 900).alias("progress")), "job", "l_orderkey"),
    ]
    parts = [validation.range_findings(*check) for check in checks]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("value", F.round("value", 9))


@query
def val22_exclusive_items(spark, d):
    return validation.exclusive_findings(views.profiles(spark, d), views.products(spark, d), views.services(spark, d))


@query
def val23_field_score_rows(spark, d):
    rows = validation.field_score_rows(views.profiles(spark, d))
    return rows.select(
        "profile_id", "field_group", big("total_fields", "total_fields"), big("populated_fields", "populated_fields"), "score"
    )


# --- profile store ---------------------------------------------------------------------------------


def _store(spark, d):
    """Saved rows of all customers; the account's sign tells apart two versions."""
    return views.table(spark, d, "customer").select(
        F.concat(F.lit("job_"), "c_custkey").alias("job_id"),
        F.col("c_name").alias("business_name"),
        F.col("c_mktsegment").alias("category"),
        F.when(F.col("c_acctbal") < 0, 2).otherwise(1).cast("bigint").alias("version"),
        F.lit("2024-01-01").alias("saved_at"),
    )


def _edits(spark, d):
    """New data per nation of suppliers and for suppliers' keys beyond the customers."""
    return views.table(spark, d, "supplier").select(
        F.concat(F.lit("job_"), F.when(F.col("s_nationkey") < 5, F.lit("s")).otherwise(""), "s_suppkey").alias("job_id"),
        F.col("s_name").alias("business_name"),
        F.lit("EDITED").alias("category"),
    )


def _profile_edits(spark, d):
    edits = _edits(spark, d).withColumn("edit_order", F.lit(0))
    again = edits.filter("job_id like '%3'").select(
        "job_id", F.concat("business_name", F.lit(" again")).alias("business_name"), F.lit("AGAIN").alias("category"),
        F.lit(1).alias("edit_order"),
    )
    return again.unionByName(edits)


def _upsert(base, edits):
    return profiles.upsert(base, edits, F.lit("2024-02-01"), "edit_order")


def _edited_store(spark, table, key, changes, edit):
    """The table written to a store, edited there, and read back; the batch is retried and applies once."""
    folder = new_folder(spark, "store")
    edit_store.create(table, folder, key)
    for _ in range(2):
        edit_store.apply(spark, folder, 1, changes, edit)
    return edit_store.read(spark, folder)


@query
def pro1_upsert(spark, d):
    merged = _upsert(_store(spark, d), _profile_edits(spark, d))
    return merged.select("job_id", "business_name", "category", big("version", "version"), "saved_at")


@query
def pro1_stored_upsert(spark, d):
    merged = _edited_store(spark, _store(spark, d), "job_id", _profile_edits(spark, d), _upsert)
    return merged.select("job_id", "business_name", "category", big("version", "version"), "saved_at")


@query
def pro2_delete(spark, d):
    return profiles.delete(_store(spark, d), _edits(spark, d)).select("job_id", "business_name")


@query
def pro2_stored_delete(spark, d):
    left = _edited_store(spark, _store(spark, d), "job_id", _edits(spark, d), profiles.delete)
    return left.select("job_id", "business_name")


def _dense_services(spark, d):
    base = views.services(spark, d).select("profile_id", F.col("ordinal").alias("order_key"), "name", "category")
    dense = profiles.with_service_id(number_rows(base, ["profile_id"], "order_key", "ordinal"))
    return dense.select("profile_id", "ordinal", "service_id", "name", "category")


def _service_changes(spark, d):
    changes = views.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("profile_id"), F.col("s_nationkey").cast("bigint").alias("ordinal"),
        F.lit("svc_new").alias("service_id"), F.col("s_name").alias("name"), F.lit("changed").alias("category"),
        F.lit(1).alias("edit_order"),
    )
    earlier = changes.withColumns({"name": F.lit("overwritten"), "edit_order": F.lit(0)})
    return changes.unionByName(earlier)


def _replace(base, changes):
    return profiles.replace_services(base, changes, "edit_order")


@query
def pro3_replace_services(spark, d):
    return _replace(_dense_services(spark, d), _service_changes(spark, d))


@query
def pro3_stored_replace(spark, d):
    return _edited_store(spark, _dense_services(spark, d), "profile_id", _service_changes(spark, d), _replace)


def _added_services(spark, d):
    return views.table(spark, d, "part").select(
        F.col("p_size").cast("bigint").alias("profile_id"), F.col("p_partkey").alias("order_key"),
        F.col("p_name").alias("name"), F.lit("part").alias("category"),
    )


def _append(base, added):
    return profiles.append_services(base, added, "order_key")


@query
def pro4_append_services(spark, d):
    return _append(_dense_services(spark, d), _added_services(spark, d))


@query
def pro4_stored_append(spark, d):
    return _edited_store(spark, _dense_services(spark, d), "profile_id", _added_services(spark, d), _append)


@query
def pro5_delete_services(spark, d):
    base = _dense_services(spark, d)
    return profiles.delete_services(base, base.filter("category = 'F'"))


@query
def pro5_stored_delete(spark, d):
    base = _dense_services(spark, d)
    removed = base.filter("category = 'F'").select("profile_id", "ordinal")
    return _edited_store(spark, base, "profile_id", removed, profiles.delete_services)


@query
def pro6_list(spark, d):
    listed = profiles.list_profiles(views.profiles(spark, d), views.services(spark, d), views.products(spark, d))
    return listed.select("job_id", "business_name", "business_type", "services_count", "products_count", "saved_at")


@query
def pro7_all_items(spark, d):
    both = profiles.all_items(views.services(spark, d), views.products(spark, d))
    return both.select("profile_id", "item_kind", "ordinal", "name", "base_price", "service_id", "product_id")


@query
def pro8_flatten(spark, d):
    flat = views.service_maps(spark, d).select(
        "profile_id", "ordinal", profiles.flatten_item(F.col("item"), F.col("details")).alias("flat")
    )
    return flat.select("profile_id", "ordinal", F.explode("flat").alias("key", "value"))


@query
def pro9_humanize(spark, d):
    key = F.concat(F.translate("p_name", " ", "_"), F.lit("-"), F.lower(F.substring("p_type", 1, 3)), F.initcap("p_type"))
    return views.table(spark, d, "part").select("p_partkey", key.alias("key"), profiles.humanize(key).alias("label"))


@query
def pro10_badges(spark, d):
    fields = ["itinerary", "inclusions", "exclusions", "faqs", "tags"]
    found = profiles.badges(views.services(spark, d), fields, ["profile_id", "ordinal"])
    return found.select("profile_id", "ordinal", "field", "label", big("entries", "entries"))


@query
def pro11_policies(spark, d):
    kept = views.service_maps(spark, d).select("profile_id", "ordinal", F.explode(profiles.policy_fields(F.col("item"))))
    return kept.select("profile_id", "ordinal", "key", "value")


@query
def pro12_price_labels(spark, d):
    return views.services(spark, d).select(
        "profile_id", "ordinal", profiles.price_label(F.col("base_price"), F.col("currency")).alias("label")
    )


@query
def pro13_first_key(spark, d):
    details = F.coalesce("details", F.create_map().cast("map<string,string>"))
    return views.service_maps(spark, d).select(
        "profile_id", "ordinal", profiles.first_key(details, ["price", "grade", "duration"]).alias("key")
    )


@query
def pro14_migrate(spark, d):
    versioned = _store(spark, d).select(
        "job_id", "category", F.when(F.col("version") == 2, "1.1").when(F.col("category") == "BUILDING", "0.9")
        .otherwise("1.0").alias("schema_version"),
    )
    steps = {"1.0->1.1": {"price_type": F.lit("per unit"), "category": F.lower("category")}}
    done, rejected = profiles.migrate(versioned, "1.1", steps)
    return done.unionByName(rejected, allowMissingColumns=True)


# --- jobs ---------------------------------------------------------------------------------------------


@query
def job1_latest_status(spark, d):
    return jobs.latest_status(views.job_events(spark, d))


@query
def job1_status_stream(spark, d):
    schema = views.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    folder = new_folder(spark, "status")
    started = job_status.start_status_stream(views.as_job_events(stream), folder, new_folder(spark, "status-log"))
    started.awaitTermination()
    return job_status.read_status(spark, folder)


@query
def job2_progress(spark, d):
    found = views.job_events(spark, d)
    return found.select("event_id", "phase", jobs.phase_progress(F.col("phase")).alias("progress"))


@query
def job3_count_by_status(spark, d):
    return jobs.count_by_status(jobs.latest_status(views.job_events(spark, d)))


@query
def job4_phase_durations(spark, d):
    found = jobs.phase_durations(views.job_events(spark, d))
    return found.select("job_id", "event_id", "phase", F.round("seconds", 3).alias("seconds"))


@query
def job4_phase_totals(spark, d):
    return jobs.phase_totals(jobs.phase_durations(views.job_events(spark, d)))


@query
def job5_outcome_rates(spark, d):
    return jobs.outcome_rates(jobs.latest_status(views.job_events(spark, d)))


def _ingested(spark, d):
    """An index fed by a stream of documents in three arrivals.

    A third of the documents first comes with other words at its end, then all come, then a fifth comes again unchanged.
    """
    folder, arrivals = new_folder(spark, "stream-index"), new_folder(spark, "arrivals")
    docs = views.table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.lit(1).cast("bigint").alias("page_number"), "text", F.col("doc_id").alias("n")
    )
    obsolete = F.concat("text", F.lit(" obsolete draft price"))
    for part in (docs.filter("n % 3 = 0").withColumn("text", obsolete), docs, docs.filter("n % 5 = 0")):
        part.drop("n").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(part.drop("n").schema).parquet(arrivals)
        pages = ingest.arrived_now(stream.select("*", "_metadata")).drop("_metadata")
        ingest.start_ingest(pages, folder, f"{folder}-log", merge_every=2).awaitTermination()
    return folder


@query
def job6_ingest_stream(spark, d):
    return ingest.read_postings(spark, _ingested(spark, d)).select(
        "doc_id", "page_number", "keyword", F.round("relevance", 6).alias("relevance")
    )


@query
def job6_stream_lookup(spark, d):
    """The postings of all query terms in the index that the stream keeps."""
    terms = _terms(spark, d)
    found = retrieval.term_postings(terms, ingest.read_postings(spark, _ingested(spark, d), terms))
    return found.select("query_id", "keyword", "doc_id", "page_number", F.round("relevance", 6).alias("relevance"))
