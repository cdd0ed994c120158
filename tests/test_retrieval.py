import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.operators import index, retrieval, sizing

PAGES = "doc_id string, source_file string, page_number long, text string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("a", "x/a.pdf", 1, "The price list. Price of burgers and more prices."),
        ("a", "x/a.pdf", 2, "Opening hours daily, fee for parking."),
        ("b", "x/b.docx", 1, "Nothing relevant here except burgers burgers burgers burgers."),
        ("c", "x/c.pdf", 1, "  "),
    ]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "price burgers"), (2, "absentword"), (3, "")], "query_id long, query string")


@pytest.fixture(scope="module")
def answers(spark, pages, questions):
    return {r["query_id"]: r for r in retrieval.answer(questions, index.postings(pages), pages).collect()}


def test_synonyms_reach_other_pages(answers):
    got = answers[1]
    assert got["matched_pages"] == 3
    assert [(p["doc_id"], p["page_number"]) for p in got["ranked_pages"]] == [("a", 1), ("b", 1), ("a", 2)]
    # price: 3 hits .6 + business .2 + head .2; burgers: .2 + .2
    assert [p["score"] for p in got["ranked_pages"]] == [1.4, 0.8, 0.4]
    assert got["confidence"] == 1.0


def test_context_is_in_rank_order(answers):
    parts = answers[1]["context"].split("\n\n")
    assert parts[0].startswith("[Document: a.pdf, Page 1]\n") and parts[1].startswith("[Document: b.docx, Page 1]\n")


@pytest.mark.parametrize("query", [2, 3])
def test_query_without_hits(answers, query):
    got = answers[query]
    assert (got["matched_pages"], got["confidence"], got["context"], got["ranked_pages"]) == (0, 0.0, "", None)


def test_confidence_without_cap(spark, pages):
    asked = spark.createDataFrame([(9, "parking")], "query_id long, query string")
    got = retrieval.answer(asked, index.postings(pages), pages).first()
    assert got["confidence"] == pytest.approx(0.4 + 0.1)


def test_same_result_without_broadcast(spark, pages, questions, answers, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    again = {r["query_id"]: r for r in retrieval.answer(questions, index.postings(pages), pages).collect()}
    assert again == answers


def test_missing_pages_leave_the_context(pages, questions, answers):
    got = retrieval.answer(questions, index.postings(pages), pages.filter("doc_id <> 'a'")).filter("query_id = 1").first()
    assert got["context"].startswith("[Document: b.docx") and "a.pdf" not in got["context"]
    assert got["confidence"] == answers[1]["confidence"]


def test_synonym_table(spark):
    asked = spark.createDataFrame([(1, " ".join(fv.SYNONYMS))], "query_id long, query string")
    terms = {r["keyword"] for r in retrieval.query_terms(asked).collect()}
    assert terms == set(fv.SYNONYMS) | {s for v in fv.SYNONYMS.values() for s in v}


def test_lookup(spark, pages):
    words = spark.createDataFrame([("BURGERS",), ("none",)], "keyword string")
    got = retrieval.keyword_lookup(words, index.postings(pages), pages, first=1).collect()
    assert [(r["keyword"], r["total_hits"], r["doc_id"]) for r in got] == [("burgers", 2, "a")]
    assert got[0]["snippet"] == "The price list. Price of burgers and more prices."


def test_snippet_choice_packs_and_unpacks(spark):
    rows = [(0.6000000000000001, 7, 200), (0.6, 3, 150), (1.0, 4_000_000, 10)]
    df = spark.createDataFrame(rows, "relevance double, term_no int, chars int")
    code = retrieval._snippet_rank() + F.col("chars")
    got = df.select(
        "relevance", "term_no", "chars", code.alias("c"), retrieval._snippet_term(code).alias("t"),
        retrieval._snippet_length(code).alias("n"),
    ).orderBy("c").collect()
    assert [r["term_no"] for r in got] == [4_000_000, 3, 7]
    assert all(r["t"] == r["term_no"] and r["n"] == r["chars"] for r in got)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_posting_lists_hold_every_posting_once(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", broadcast_rows)
    pages = spark.createDataFrame([(f"d{i}", "f.pdf", 1, f"common word{i % 7}") for i in range(500)], PAGES)
    postings = index.postings(pages)
    lists = index.posting_lists(postings, segment_rows=50).collect()
    common = [r for r in lists if r["keyword"] == "common"]
    assert len(common) == 10 and max(len(r["refs"]) for r in common) < 100
    assert sum(len(r["refs"]) for r in lists) == postings.count()
    assert {ref["doc_id"] for r in common for ref in r["refs"]} == {f"d{i}" for i in range(500)}


def test_index_tree_nodes_and_stats(spark, pages):
    nodes = {r["node_id"]: r for r in index.index_tree(pages).collect()}
    assert nodes["root"]["title"] == "Index containing 3 documents" and len(nodes) == 4
    docs = {r["doc_id"]: r for r in index.document_nodes(pages).collect()}
    assert docs["a"]["end_page"] == 2 and docs["a"]["content_snippet"].startswith("The price")
    stats = index.index_stats(pages, pages.limit(0), pages.limit(0)).first()
    assert (stats["total_documents"], stats["total_tree_nodes"], stats["total_tables"]) == (3, 4, 0)
    assert index.index_stats(pages.limit(0), pages, pages).first()["total_tree_nodes"] == 0
    rough = index.index_stats(pages, pages, pages, approximate=True).first()["total_keywords"]
    assert abs(rough - stats["total_keywords"]) <= 1


def test_sketches_of_batches_merge_within_the_bound(spark, tmp_path):
    """Each batch is read once, on its own; the merged estimates lie within 2.5 % of the exact counts."""
    batches = [
        spark.createDataFrame([(f"d{i % 900}", "f.pdf", i, f"word{i} common other{i % 700}") for i in range(a, a + 1500)], PAGES)
        for a in range(0, 6000, 1000)
    ]
    for n, batch in enumerate(batches):
        index.stats_sketch(batch).write.parquet(str(tmp_path / f"batch={n}"))
    got = index.merged_stats(spark.read.parquet(*(str(tmp_path / f"batch={n}") for n in range(6)))).first()
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.unionByName(batch)
    want = index.keyword_stats(whole).first()
    assert (got.total_pages, got.avg_keywords_per_page) == (want.total_pages, want.avg_keywords_per_page)
    assert got.total_keywords == pytest.approx(want.total_keywords, rel=0.025)
    assert got.total_documents == pytest.approx(want.total_documents, rel=0.025)
    none = index.merged_stats(index.stats_sketch(batches[0].limit(0))).first()
    assert (none.total_pages, none.total_keywords) == (0, 0)


def test_compress_keeps_the_best(spark):
    rows = [("d%02d" % i, 1, "k", i / 20, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, page_number long, keyword string, relevance double, position int")
    kept = index.compress(df, 10)
    assert [r["doc_id"] for r in kept.orderBy("rank").collect()] == ["d%02d" % i for i in range(19, 9, -1)]


def test_media_postings_keep_only_described_images(spark):
    images = spark.createDataFrame([("i1", "p/1.jpg", "d"), ("i2", "p/2.jpg", "d")], "image_id string, file_path string, source_doc string")
    found = spark.createDataFrame([("i1", "A red burger", "food")], "image_id string, description string, category string")
    got = index.media_postings(images, found).collect()
    assert {(r["keyword"], r["image_id"], r["category"]) for r in got} == {("red", "i1", "food"), ("burger", "i1", "food")}
